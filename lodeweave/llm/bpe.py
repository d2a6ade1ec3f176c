"""BPE with word ends, encoded in batched numpy merge rounds.

The merge table becomes one sorted array of pair keys. The symbols of many
words stand in one flat array; each round finds every adjacent pair's rank by
binary search, picks the lowest rank of each word with ``minimum.reduceat`` and
merges it, until no word holds a known pair. A vocabulary file is read where
the code runs; its path is a parameter.

Words repeat, so a bounded cache keeps the ids of white-space separated chunks;
only chunks that are not in it go through the merge rounds. No result depends
on the cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import regex

#: Unicode White_Space, which is what ``\s`` means to the vocabulary's patterns.
_SPACE = re.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
#: str.split() would also cut at these four, which are no white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in plain:
        table[b] = chr(b)
    for b in range(256):
        if not table[b]:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class WordBpe:
    """Encoder and decoder for one vocabulary file (byte-level BPE with a word-end suffix)."""

    def __init__(self, path: str, cache_entries: int = 300_000, cache_chars: int = 8_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        patterns = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self._pieces = regex.compile(patterns[0])
        symbols = byte_symbols()
        self._inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self._final = np.array([vocab[c + end] for c in symbols], dtype=np.int64)
        self._tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self._width = max(self._tokens) + 1

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys, rank = left * self._width + right, np.arange(len(pairs), dtype=np.int32)
        # Merging a pair everywhere at once equals merging it place by place,
        # unless what it makes takes part in a merge of a lower rank.
        first_use = np.full(self._width, _NONE, dtype=np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], rank[order]
        self._made, self._at_once = made, first_use[made] > rank
        self._cache_entries, self._cache_chars = cache_entries, cache_chars
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._flat = np.zeros(1 << 16, dtype=np.uint32)
        self._starts = np.zeros(1 << 14, dtype=np.int64)
        self._known = self._chars = 0

    # -- merge rounds -----------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, found by binary search; the highest number where there is none."""
        key = left * self._width + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word. No word may be empty."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(lengths)
        sym = self._inner[flat]
        sym[ends - 1] = self._final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = np.full(len(sym), _NONE, dtype=np.int32)  # of the pair that starts here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            if not live.all():
                keep = np.repeat(live, size)
                done.append((word[~keep], sym[~keep]))
                sym, word, rank, best, size = sym[keep], word[keep], rank[keep], best[live], size[live]
                if not len(sym):
                    break
            spread = np.repeat(best, size)
            place = np.flatnonzero(rank == spread)
            chosen = spread[place]
            # In a run of equal symbols the pairs overlap: every second one counts.
            other = word[place[1:]] != word[place[:-1]]
            run_at = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | other])
            take = ((np.arange(len(place)) - np.repeat(run_at, np.diff(np.r_[run_at, len(place)]))) & 1) == 0
            single = ~self._at_once[chosen]
            if single.any():
                take &= ~single | np.r_[True, other]
            place, chosen = place[take], chosen[take]
            sym[place] = self._made[chosen]
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            at = place - np.arange(len(place))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # Only the pairs beside a merge have changed.
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(sym)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._ranks(sym[changed], sym[changed + 1])
        if not done:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([s for _, s in done])[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    # -- texts ------------------------------------------------------------

    def words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of chunks without white space, and the number of each chunk's words.

        Chunks are composed and lower-cased, then cut by the vocabulary's pattern.
        """
        text = " ".join(chunks)
        if not text.isascii():
            # The library lower-cases by character: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out: list[str] = []
        each = []
        for chunk in text.lower().split(" "):
            if chunk.isalpha():
                out.append(chunk)
                each.append(1)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
                out += (chunk[:-1], chunk[-1])
                each.append(2)
            else:
                found = self._pieces.findall(chunk)
                out += found
                each.append(len(found))
        return out, np.array(each, dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        words, each = self.words(chunks)
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        ids, counts = self.merge([w.encode() for w in number])
        begin, width = (np.cumsum(counts) - counts)[which], counts[which]
        ids = ids[np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
        ends = np.r_[0, np.cumsum(width)][np.cumsum(each)]
        base, used = len(self._index), self._known
        while used + len(ids) > len(self._flat):
            self._flat = np.r_[self._flat, np.zeros_like(self._flat)]
        while base + len(chunks) + 1 > len(self._starts):
            self._starts = np.r_[self._starts, np.zeros_like(self._starts)]
        self._flat[used : used + len(ids)] = ids
        self._starts[base + 1 : base + len(chunks) + 1] = used + ends
        self._known += len(ids)
        self._index.update(zip(chunks, range(base, base + len(chunks)), strict=True))

    def _learn_special(self, token: str) -> None:
        base, used = len(self._index), self._known
        self._flat = np.r_[self._flat, np.zeros(8, dtype=np.uint32)]
        self._starts = np.r_[self._starts, np.zeros(8, dtype=np.int64)]
        self._flat[used] = self.specials[token]
        self._starts[base + 1] = used + 1
        self._known += 1
        self._index[" " + token] = base  # no chunk starts with a space

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks; a special token is a chunk with a space before it."""
        if self._special and "<|" in text and self._special.search(text):
            out: list[str] = []
            at = 0
            for m in self._special.finditer(text):
                out += self._split(text[at : m.start()])
                out.append(" " + m[0])
                at = m.end()
            return out + self._split(text[at:])
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one uint32 array, and the number of ids of each text."""
        if len(self._index) > self._cache_entries or self._chars > self._cache_chars:
            self._clear()
        split = [self.chunks(t) for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        every = list(chain.from_iterable(split))
        flat = np.fromiter(map(self._index.get, every, repeat(-1)), dtype=np.int64, count=len(every))
        missing = np.flatnonzero(flat < 0).tolist()
        if missing:
            absent = [every[k] for k in missing]
            new = dict.fromkeys(absent)
            self._chars += sum(map(len, new))
            for c in [c for c in new if c[0] == " "]:
                self._learn_special(c[1:])
                del new[c]
            if new:
                self._learn(list(new))
            flat[missing] = [self._index[c] for c in absent]
        begin = self._starts[flat]
        width = self._starts[flat + 1] - begin
        before = np.r_[0, np.cumsum(width)]
        ids = self._flat[np.repeat(begin - before[:-1], width) + np.arange(before[-1])]
        bounds = before[np.r_[0, np.cumsum(sizes)]]
        return ids, np.diff(bounds)

    def decode(self, ids: list[int]) -> str:
        """The library's decode() with special tokens kept: without a decoder, the tokens joined by spaces."""
        return " ".join(map(self._tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each path and worker process."""
    return WordBpe(path)
