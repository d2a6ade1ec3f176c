"""Suffix-array dedup: bytes covered by a string of ``WIDTH`` that starts earlier too are removed.

1. Each text is cut into runs of starts with a common anchor (``anchors``). One
   row for each run, keyed by its anchor, is shuffled; of runs of a task that are
   equal byte by byte the earliest alone goes on, so that a passage or a copy may
   have any share of the rows.
2. A run that is alone under its anchor repeats nothing, since equal strings
   have equal anchors. The places of all others go back to their documents.
3. The bytes of these runs are dealt by anchor, once for each task's equal ones.
   A task sorts the suffixes of each shard of the strings it got once and merges
   the shards' Burrows-Wheeler transforms by interleave refinement (``bwt``).
   Intervals with a common prefix of ``WIDTH`` are repeats: of all places of an
   interval's strings the earliest stays. A string that came several times stands
   in the transforms once, and its places all count.
4. Each document's removed ranges are joined to its text.

An anchor with very many different runs (over ``MAP_HOT`` in a task, or ``HOT`` in
all) would fill one task, so its strings are dealt one by one, by a hash of each
whole string, and go through the same transforms. Hashes only deal strings out
and name symbols: a range is removed only after its bytes are compared.

Defined results: null and empty texts have no bytes; texts shorter than
``WIDTH`` lose nothing; long texts are read in parts that overlap, and whole;
rows without an id lose nothing and repeat for nobody; rows with one id are one
document's versions, and a range that is removed from one is removed from each
that reaches so far; ids that are no integers count in their own order; an empty
table gives no rows; other columns stay, whatever their names, unless an output
has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, bwt, common, words
from .anchors import K, WIDTH

PART = 1 << 20
FLUSH_BYTES = 24 << 20
CHUNK_ROWS = 1 << 18
MAP_HOT, HOT = 64, 4096
GROUP_BYTES, SHARD_BYTES = 1 << 20, 1 << 18
DEPTH = WIDTH // bwt.STRIDE

_RUN, _GONE, _ASK, _MARK = 0, 1, 2, 3
_RUNS = "key long, whole long, doc long, start long, info int"
_FOUND = "doc long, start long, size int, info int"
_STRINGS = "key long, doc long, start long, size int, info int, bytes binary"
_RANGES = "doc long, start long, size int"


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def _united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document that don't touch, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    own = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    span = np.int64(max(1, int(end.max()) + 1))
    reach = np.maximum.accumulate(end + own * span) - own * span
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys differ from the row ahead."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _lead(first: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it that is a first."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Whether ``size`` bytes, at least one, from ``a`` and from ``b`` on are equal."""
    out = np.zeros(len(a), dtype=bool)
    stop = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + block, side="right")))
        begin = stop[i:j] - size[i:j]
        step = np.arange(stop[j - 1] - begin[0]) - np.repeat(begin - begin[0], size[i:j])
        unlike = raw[np.repeat(a[i:j], size[i:j]) + step] != raw[np.repeat(b[i:j], size[i:j]) + step]
        out[i:j] = np.add.reduceat(unlike, begin - begin[0], dtype=np.int64) == 0
        i = j
    return out


def _combined(raw: np.ndarray, r: dict[str, np.ndarray], size: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows of ``key, whole, doc, start, place`` in that order, those that go on, and those equal byte by byte to one that goes on and starts earlier.

    A row that repeats another's place goes nowhere.
    """
    order = np.lexsort((r["start"], r["doc"], r["whole"], r["key"]))
    r, size = {k: v[order] for k, v in r.items()}, size[order]
    first = _first_of(r["key"], r["whole"])
    lead = _lead(first)
    moved = (r["doc"] != r["doc"][lead]) | (r["start"] != r["start"][lead])
    asked = np.flatnonzero(~first)
    like = np.zeros(len(first), dtype=bool)
    like[asked] = (size[asked] == size[lead[asked]]) & _same(raw, r["place"][asked], r["place"][lead[asked]], np.minimum(size[asked], size[lead[asked]]))
    return r, first | ~like, like & moved


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, rows and first places of texts, with texts of over ``PART`` bytes cut so that each string is whole in one part."""
    if len(raw) <= 2 * PART - WIDTH:
        yield raw, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, dtype=np.int64)
        return
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for s in range(0, max(1, b - a - WIDTH + 1), PART):
            piece = raw[a + s : min(b, a + s + PART + WIDTH - 1)]
            yield piece, np.array([0, len(piece)]), np.array([r]), np.array([s])


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys for rows that only pass through: anything that spreads them."""
    return words.mix(doc.view(np.uint64) * np.uint64(31) + start.view(np.uint64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: ``_RUNS`` rows of a task."""
    held: list[dict[str, np.ndarray]] = []
    raws: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        r = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        raw = np.concatenate(raws)
        r["key"] = r.pop("anchor")
        r, stay, later = _combined(raw, r, r["count"] + WIDTH - 1)
        doc, a, b = _united(r["doc"][later], r["start"][later], (r["start"] + r["count"] + WIDTH - 1)[later])
        if len(doc):
            yield _batch(key=_spread(doc, a), whole=b - a, doc=doc, start=a, info=np.full(len(doc), _GONE << 16, dtype=np.int32))
        r = {k: v[stay] for k, v in r.items()}
        begin = np.flatnonzero(_first_of(r["key"]))
        kinds = np.diff(np.r_[begin, len(r["key"])])
        hot = np.repeat(kinds > MAP_HOT, kinds)
        info = (r["count"] | r["back"] << 8 | np.where(hot, _ASK, _RUN) << 16).astype(np.int32)
        yield _batch(key=np.where(hot, _spread(r["doc"], r["start"]), r["key"]), whole=np.zeros(len(info), dtype=np.int64), doc=r["doc"], start=r["start"], info=info)
        marks = r["key"][begin][kinds > MAP_HOT]
        if len(marks):
            none = np.zeros(len(marks), dtype=np.int64)
            yield _batch(key=marks, whole=none, doc=none, start=none, info=np.full(len(marks), _MARK << 16, dtype=np.int32))

    for batch in common.slices(batches, "text", PART):
        ids = batch.column("doc").to_numpy()
        for raw, offsets, row, first in _parts(*words.flat(batch.column("text"))):
            found = anchors.runs(raw, offsets, first)
            if len(found["row"]):
                found["doc"] = ids[row[found.pop("row")]]
                found["place"] = found["place"] + size
                held.append(found)
                raws.append(raw)
                size += len(raw)
            if size > FLUSH_BYTES:
                yield from flush()
                held, raws, size = [], [], 0
    if held:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows in the order of keys: ``_FOUND`` rows: ranges that are removed (info 0), and runs that aren't alone (info: count, back, and 1 << 16 for those of hot anchors)."""
    names = ("key", "doc", "start", "info")
    none = {k: np.zeros(0, dtype=np.int32 if k == "info" else np.int64) for k in names}
    carry, known_hot = none, None

    def asked(r: dict[str, np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
        return _batch(doc=r["doc"], start=r["start"], size=np.zeros(len(hot), dtype=np.int32), info=(r["info"] & 0xFFFF) | hot.astype(np.int32) << 16)

    def groups(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(_first_of(r["key"]))
        size = np.diff(np.r_[begin, len(r["key"])])
        mark = (r["info"] >> 16) == _MARK
        marked = np.repeat(np.add.reduceat(mark, begin, dtype=np.int64) > 0, size)
        keep = ((np.repeat(size, size) > 1) | marked) & ~mark
        hot = marked | (np.repeat(size, size) > HOT)
        if keep.any():
            yield asked({k: v[keep] for k, v in r.items()}, hot[keep])

    for table in common.chunks(batches, CHUNK_ROWS):
        kind = table["info"].to_numpy() >> 16
        r = {k: table[k].to_numpy() for k in names}
        gone, ask = kind == _GONE, kind == _ASK
        if gone.any():
            yield _batch(doc=r["doc"][gone], start=r["start"][gone], size=table["whole"].to_numpy()[gone].astype(np.int32), info=np.zeros(int(gone.sum()), dtype=np.int32))
        if ask.any():
            yield asked({k: v[ask] for k, v in r.items()}, np.ones(int(ask.sum()), dtype=bool))
        r = {k: np.concatenate([carry[k], v[~gone & ~ask]]) for k, v in r.items()}
        if known_hot is not None:
            on = (r["key"] == known_hot) & ((r["info"] >> 16) != _MARK)
            if on.any():
                yield asked({k: v[on] for k, v in r.items()}, np.ones(int(on.sum()), dtype=bool))
            r = {k: v[r["key"] != known_hot] for k, v in r.items()}
        if not len(r["key"]):
            carry = none
            continue
        last = int(np.flatnonzero(_first_of(r["key"]))[-1])
        if last:
            yield from groups({k: v[:last] for k, v in r.items()})
        carry = {k: v[last:] for k, v in r.items()}
        if len(carry["key"]) > HOT:  # a key of unknown length: its rows need not be held
            known_hot = carry["key"][0]
            on = (carry["info"] >> 16) != _MARK
            yield asked({k: v[on] for k, v in carry.items()}, np.ones(int(on.sum()), dtype=bool))
            carry = none
    if len(carry["key"]):
        yield from groups(carry)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3a: the bytes of runs, keyed by anchor, and of strings of hot anchors, keyed by their own hash; info is the number of starts, or -1 for a range that is removed."""
    held: list[dict[str, np.ndarray]] = []
    raws: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        raw = np.concatenate(raws)
        r = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        r, stay, later = _combined(raw, r, r["count"] + WIDTH - 1)
        doc, a, b = _united(r["doc"][later], r["start"][later], (r["start"] + r["count"] + WIDTH - 1)[later])
        if len(doc):
            yield pa.RecordBatch.from_pydict({"key": pa.array(_spread(doc, a).view(np.int64)), "doc": pa.array(doc), "start": pa.array(a), "size": pa.array((b - a).astype(np.int32)), "info": pa.array(np.full(len(doc), -1, dtype=np.int32)), "bytes": pa.nulls(len(doc), pa.binary())})
        data = raw.tobytes()
        rows = np.flatnonzero(stay)
        for i in range(0, len(rows), 1 << 16):
            at = rows[i : i + (1 << 16)]
            count, place = r["count"][at], r["place"][at]
            cut = [data[x:y] for x, y in zip(place.tolist(), (place + count + WIDTH - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(r["key"][at].view(np.int64)), "doc": pa.array(r["doc"][at]), "start": pa.array(r["start"][at]), "size": pa.array(np.zeros(len(at), dtype=np.int32)), "info": pa.array(count.astype(np.int32)), "bytes": pa.array(cut, pa.binary())})

    for batch in common.slices(batches, "text", PART):
        raw, offsets = words.flat(batch.column("text"))
        runs = batch.column("asked")
        flat = runs.flatten()
        owner = np.repeat(np.arange(len(offsets) - 1), runs.value_lengths().to_numpy(zero_copy_only=False))
        start, info = flat.field("start").to_numpy(zero_copy_only=False), flat.field("info").to_numpy(zero_copy_only=False).astype(np.int64)
        at = offsets[owner] + start
        count, back, hot = info & 0xFF, info >> 8 & 0xFF, info >> 16 == 1
        inside = at + count + WIDTH - 1 <= offsets[owner + 1]  # versions of a document may be shorter
        doc = batch.column("doc").to_numpy()[owner]
        for own in (np.flatnonzero(~hot & inside), np.flatnonzero(hot & inside)):
            if not len(own):
                continue
            own = own[np.argsort(at[own], kind="stable")]
            place, n, d, s, anchor = at[own], count[own], doc[own], start[own], (at + back)[own]
            if hot[own[0]]:  # string by string
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                place, d, s = np.repeat(place, n) + step, np.repeat(d, n), np.repeat(s, n) + step
                n = np.ones(len(place), dtype=np.int64)
                order = np.argsort(place, kind="stable")
                place, d, s = place[order], d[order], s[order]
            whole = words.hashes(raw, place, place + n + WIDTH - 1, anchors._IDENTITY)
            if hot[own[0]]:
                key = whole
            else:
                order = np.argsort(anchor, kind="stable")
                key = np.empty(len(own), dtype=np.uint64)
                key[order] = words.hashes(raw, anchor[order], anchor[order] + K, anchors._IDENTITY)
            held.append({"key": key, "whole": whole, "doc": d, "start": s, "count": n, "place": place + size})
        if len(owner):
            raws.append(raw)
            size += len(raw)
        if size > FLUSH_BYTES and held:
            yield from flush()
            held, raws, size = [], [], 0
    if held:
        yield from flush()


def _symbols(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the blocks from each place on; 0 at the last places of each string, whose blocks are not whole."""
    out = np.zeros(len(raw), dtype=np.uint64)
    start = np.arange(max(0, len(raw) - bwt.STRIDE + 1))
    out[: len(start)] = words.hashes(raw, start, start + bwt.STRIDE, anchors._IDENTITY) | np.uint64(1)
    out[(ends[:, None] - 1 - np.arange(bwt.STRIDE)[None]).ravel()] = 0
    return out


def repeated(strings: list[bytes], count: np.ndarray, times: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings, starts (below each string's ``count``) and intervals of the repeats of ``WIDTH`` bytes, by merged transforms; a string that stands for several ``times`` repeats by itself."""
    lengths = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    symbol = _symbols(raw, ends)
    # The same code for the same block in all shards.
    values, code = np.unique(symbol, return_inverse=True)
    code = code if values[0] == 0 else code + 1
    shards, base, first, begin = [], [], 0, 0
    for stop in [*np.flatnonzero(np.diff(ends // shard_bytes)).tolist(), len(strings) - 1]:
        offsets = np.r_[begin, ends[first : stop + 1]]
        shards.append(bwt.Shard.of(code[begin : ends[stop]], offsets - begin))
        base.append(begin)
        first, begin = stop + 1, int(ends[stop])
    home, place, interval = bwt.intervals(shards, DEPTH)
    place = place + np.array(base)[home]
    which = np.repeat(np.arange(len(strings)), lengths)[place]
    start = place - (ends - lengths)[which]
    own = start < count[which]
    which, start, interval = which[own], start[own], interval[own]
    standing = np.bincount(interval, weights=None if times is None else times[which])
    several = standing[interval] > 1
    return which[several], start[several], interval[several]


def _resolve(text: pa.ChunkedArray, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 3b for whole keys: ranges that are removed."""
    coded = text.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    code, strings = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    count = np.array([len(s) - WIDTH + 1 for s in strings])
    order = np.lexsort((start, doc, code))
    code, doc, start = code[order], doc[order], start[order]
    first = _first_of(code)
    moved = _first_of(code, doc, start)  # a place that came twice counts once
    lead = np.flatnonzero(first)
    which, offset, interval = repeated(strings, count, np.add.reduceat(moved, lead, dtype=np.int64))
    # The earliest place of each interval's strings stays.
    d, s = doc[lead][which], start[lead][which] + offset
    order = np.lexsort((s, d, interval))
    which, offset, interval, d, s = (x[order] for x in (which, offset, interval, d, s))
    top = _lead(_first_of(interval))
    later = np.flatnonzero((d != d[top]) | (s != s[top]))
    begin = np.r_[0, np.cumsum([len(x) for x in strings])]
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    same = _same(raw, (begin[which] + offset)[later], (begin[which] + offset)[top[later]], np.full(len(later), WIDTH))
    later = later[same]
    a, b, c = [d[later]], [s[later]], [s[later] + WIDTH]
    # Further places of a string: all its starts are in intervals with the earliest one's.
    more = moved & ~first
    a.append(doc[more])
    b.append(start[more])
    c.append(start[more] + (count + WIDTH - 1)[code[more]])
    x, y, z = _united(np.concatenate(a), np.concatenate(b), np.concatenate(c))
    if len(x):
        yield _batch(doc=x, start=y, size=(z - y).astype(np.int32))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3b, over rows in the order of keys."""
    carry: pa.Table | None = None

    def several(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table["key"].to_numpy()
        first = _first_of(key)
        alone = first & np.r_[first[1:], True]
        table = table.filter(pa.array(~alone))
        if table.num_rows:
            yield from _resolve(table["bytes"], table["doc"].to_numpy(), table["start"].to_numpy())

    for table in common.chunks(batches, CHUNK_ROWS, GROUP_BYTES):
        ready = table["info"].to_numpy() == -1
        if ready.any():
            own = table.filter(pa.array(ready)).combine_chunks()
            yield _batch(**{c: own[c].to_numpy() for c in ("doc", "start", "size")})
            table = table.filter(pa.array(~ready))
        table = pa.concat_tables([carry, table]) if carry is not None else table
        carry = None
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(_first_of(table["key"].to_numpy()))[-1])
        if last:
            yield from several(table.slice(0, last))
        carry = table.slice(last).combine_chunks()
        if carry.num_rows > 2 * HOT:  # one string from very many tasks: its earliest place goes on
            doc, start = carry["doc"].to_numpy(), carry["start"].to_numpy()
            coded = carry["bytes"].combine_chunks().dictionary_encode()
            code = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy()
            order = np.lexsort((start, doc, code))
            first = _first_of(code[order])
            if int(first.sum()) <= HOT:
                top, moved = order[_lead(first)], ~first
                away = moved & ((doc[order] != doc[top]) | (start[order] != start[top]))
                size = carry["info"].to_numpy()[order] + WIDTH - 1
                yield _batch(doc=doc[order][away], start=start[order][away], size=size[away].astype(np.int32))
                carry = carry.take(pa.array(order[first]))
    if carry is not None and carry.num_rows:
        yield from several(carry)


def _numbered(df: DataFrame, doc_id: str) -> DataFrame:
    """``id`` and ``doc``, a number in the same order, for ids that are no integers."""
    return common.written(df.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy("id").withColumn("doc", F.monotonically_increasing_id()))


def removed_ranges(docs: DataFrame) -> DataFrame:
    """``doc, start, size`` of the byte ranges of ``doc`` (long) and ``text`` that are removed; ranges of a document may overlap."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc", F.coalesce("text", F.lit("")).alias("text")).where("doc is not null")
    # No name holds on to a table that is written, so its shuffle files can go.
    found = common.written(docs.mapInArrow(_scan, _RUNS).repartition("key").sortWithinPartitions("key").mapInArrow(_meet, _FOUND))
    asked = found.where("info > 0").groupBy("doc").agg(F.collect_list(F.struct("start", "info")).alias("asked"))
    merged = common.written(docs.join(asked, "doc").mapInArrow(_look_up, _STRINGS).repartition("key").sortWithinPartitions("key").mapInArrow(_merge, _RANGES))
    return found.where("info = 0").select("doc", "start", "size").unionAll(merged)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str = "kept", as_text: bool = False) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` and the remaining bytes of each text in ``kept``.

    ``as_text``: as a text, without the bytes of characters that a cut left incomplete.
    """
    outputs = ("n_bytes", "n_removed", "n_spans", kept)
    columns = common.others(df, outputs)
    # The input's columns stand in a struct, so that no name of theirs meets one of these.
    row = F.struct(F.lit(0).alias("none"), *(df[c] for c in columns if c != text)).alias("row")
    plain = df.select(row, df[doc_id].alias("id"), df[text].alias("text"))
    if isinstance(df.schema[doc_id].dataType, T.IntegralType):
        plain = plain.select("row", F.col("id").cast("long").alias("doc"), "text")
    else:
        plain = plain.join(_numbered(df, doc_id), "id", "left").select("row", "doc", "text")
    gone = removed_ranges(plain.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    joined = plain.join(gone, "doc", "left").select("row", "text", "gone")
    schema = T.StructType([joined.schema["row"], joined.schema["text"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", PART):
            raw, offsets = words.flat(batch.column("text"))
            column = batch.column("gone")
            flat = column.flatten()
            row = np.repeat(np.arange(len(offsets) - 1), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
            row, a, b = _united(row, start, start + size)
            length = np.diff(offsets)
            a, b = np.minimum(a, length[row]), np.minimum(b, length[row])
            some = b > a
            row, a, b = row[some], a[some], b[some]
            change = np.bincount(offsets[row] + a, minlength=len(raw) + 1) - np.bincount(offsets[row] + b, minlength=len(raw) + 1)
            stay = np.cumsum(change[: len(raw)]) == 0
            left = raw[stay].tobytes()
            bounds = np.r_[0, np.cumsum(stay)][offsets].tolist()
            cut = [left[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"),
                "text": batch.column("text"),
                "n_bytes": pa.array(length),
                "n_removed": pa.array(np.bincount(row, b - a, minlength=len(length)).astype(np.int64)),
                "n_spans": pa.array(np.bincount(row, minlength=len(length))),
                "kept": pa.array([x.decode("utf-8", "ignore") for x in cut], pa.string()) if as_text else pa.array(cut, pa.binary()),
            })

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with repeated passages cut out."""
    found = dedup(docs, as_text=True)
    return found.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 99)::BIGINT)) AS p FROM t)),
f AS (SELECT s, min((doc_id, p)) AS first FROM g GROUP BY s HAVING count(*) > 1),
r AS (SELECT g.doc_id, g.p FROM g JOIN f ON g.s = f.s AND (g.doc_id, g.p) <> f.first),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM n) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS ahead FROM i),
c AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, string_agg(substr(h, 2 * ahead + 1, 2 * (a - ahead)), '' ORDER BY a) AS kept FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""
