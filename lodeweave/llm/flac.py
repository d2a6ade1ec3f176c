"""FLAC streams of 8-bit mono samples: an encoder and a decoder that work on many frames at once.

Streams follow RFC 9639: STREAMINFO with the MD5 of the samples, a SEEKTABLE
with a point for each frame, and frames of ``BLOCK`` samples whose subframe is
constant, verbatim, fixed (orders 0 to 2) or, on request, LPC. Residuals are
Rice coded in ``1 << PARTITION`` partitions.

The decoder takes fixed orders 0 to 4, LPC and both Rice methods, finds the
frames by the seek table or, where that has gaps, one after the other, and
checks CRC-8, CRC-16, frame numbers and the MD5.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK, PARTITION, RATE = 576, 2, 8000
#: Seek points in a table, whose length has 24 bits; longer streams have one for every few frames.
POINTS = 900_000
_HEAD = np.array([0xFF, 0xF8, 0x24, 0x02], dtype=np.uint8)  # 576 samples, 8 kHz, mono, 8 bits
_WARM = 8  # bits of a warm-up sample
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


class FlacError(ValueError):
    """A stream that isn't what its checksums or its headers say."""


def _crc_tables(poly: int, bits: int, longest: int) -> np.ndarray:
    """``t[d, b]``: what a byte ``b`` with ``d`` bytes after it adds to the checksum."""
    kind = np.uint8 if bits == 8 else np.uint16
    one = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        one = ((one << 1) ^ np.where(one >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    out = np.zeros((longest, 256), dtype=kind)
    out[0] = one
    for d in range(1, longest):
        before = out[d - 1].astype(np.int64)
        out[d] = ((before << 8) & ((1 << bits) - 1)) ^ one[before >> (bits - 8)]
    return out.ravel()


_TABLES: dict[int, np.ndarray] = {}


def crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of slices of ``data`` that aren't empty."""
    longest = int(size.max())
    if bits not in _TABLES or len(_TABLES[bits]) < 256 * longest:
        _TABLES[bits] = _crc_tables(0x07 if bits == 8 else 0x8005, bits, max(longest, 16 if bits == 8 else 640))
    ahead = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(ahead, size)
    got = data[np.repeat(start, size) + step]
    return np.bitwise_xor.reduceat(_TABLES[bits][(np.repeat(size, size) - 1 - step) * 256 + got], ahead)


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers below 2**31 in their extended UTF-8 form: a row of six bytes each, and how many count."""
    size = 1 + (n >= 0x80).astype(np.int64) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), dtype=np.uint8)
    for s in range(1, 7):
        at = np.flatnonzero(size == s)
        if s == 1:
            out[at, 0] = n[at]
        else:
            out[at, 0] = (0xFF00 >> s & 0xFF) | (n[at] >> (6 * (s - 1)))
            for k in range(1, s):
                out[at, k] = 0x80 | (n[at] >> (6 * (s - 1 - k)) & 0x3F)
    return out, size


def _put(buffer: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Add numbers of up to ``width <= 17`` bits so that their last bit stands before bit ``at``."""
    last = (at - 1) >> 3
    wide = value.astype(np.int64) << (7 - ((at - 1) & 7))
    for k in range((width + 7 + 7) // 8):
        part = wide >> (8 * k) & 0xFF
        buffer += np.bincount(np.maximum(last - k, 0), part, minlength=len(buffer)).astype(np.uint8)


def _lpc(x: np.ndarray, order: int, shift: int) -> np.ndarray:
    """Quantised predictor coefficients of each frame, by the autocorrelation method."""
    z = x - x.mean(axis=1, keepdims=True)
    r = np.stack([(z[:, k:] * z[:, : x.shape[1] - k]).sum(axis=1) for k in range(order + 1)], axis=1)
    m = r[:, np.abs(np.arange(order)[:, None] - np.arange(order)[None])] + np.eye(order) * (1e-6 * r[:, :1, None] + 1e-9)
    return np.clip(np.rint(np.linalg.solve(m, r[:, 1:, None])[:, :, 0] * (1 << shift)), -2048, 2047).astype(np.int64)


def encode(payload: np.ndarray, frames: np.ndarray, lpc: int = 0) -> list[bytes]:
    """The streams of payloads that stand one after the other in ``payload``, ``frames`` blocks of bytes each. ``lpc``: an order to use wherever that isn't longer."""
    n = len(payload) // BLOCK
    x = payload.reshape(n, BLOCK).astype(np.int32) - 128
    owner = np.repeat(np.arange(len(frames)), frames)
    first = np.cumsum(frames) - frames
    number = np.arange(n) - first[owner]

    # Residuals of the best fixed order.
    one = np.diff(x, axis=1)
    two = np.diff(one, axis=1)
    weight = np.stack([np.abs(x[:, 2:]).sum(axis=1), np.abs(one[:, 1:]).sum(axis=1), np.abs(two).sum(axis=1)], axis=1)
    order = weight.argmin(axis=1)
    res = x.copy()
    for k, rows in ((1, one), (2, two)):
        at = np.flatnonzero(order == k)
        res[at, k:] = rows[at]
    coefficients, shift, is_lpc = None, 9, np.zeros(n, dtype=bool)
    if lpc:
        coefficients = _lpc(x.astype(float), lpc, shift)
        guess = np.zeros((n, BLOCK - lpc), dtype=np.int64)
        for k in range(lpc):
            guess += coefficients[:, k : k + 1] * x[:, lpc - 1 - k : BLOCK - 1 - k]
        other = x[:, lpc:] - (guess >> shift)
        is_lpc = np.abs(other).sum(axis=1) < weight.min(axis=1)
        res[is_lpc, lpc:] = other[is_lpc]
        order = np.where(is_lpc, lpc, order)
    coded = np.arange(BLOCK)[None] >= order[:, None]
    u = np.where(res >= 0, 2 * res, -2 * res - 1)
    u[~coded] = 0
    # The best Rice parameter of each partition.
    parts = 1 << PARTITION
    by_part = u.reshape(n, parts, -1)
    live = coded.reshape(n, parts, -1).sum(axis=2)
    cost = np.stack([(by_part >> k).sum(axis=2) + (1 + k) * live for k in range(9)], axis=2)
    param = cost.argmin(axis=2)
    k = np.repeat(param, BLOCK // parts, axis=1)
    bits = np.where(coded, (u >> k) + 1 + k, 0)
    extra = np.where(is_lpc, 4 + 5 + 12 * lpc, 0)
    sub_bits = 8 + _WARM * order + extra + 6 + 4 * parts + bits.sum(axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (sub_bits >= 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    sub_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, sub_bits))

    utf, utf_size = _utf8_number(number)
    head = 4 + utf_size + 1
    size = head + ((sub_bits + 7) >> 3) + 2
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for j in range(4):
        out[at + j] = _HEAD[j]
    for j in range(int(utf_size.max(initial=0))):
        some = utf_size > j
        out[at[some] + 4 + j] = utf[some, j]
    if n:
        out[at + head - 1] = crc(out, at, head - 1, 8)
    body = at + head
    out[body] = np.where(constant, 0, np.where(verbatim, 2, np.where(is_lpc, (32 + lpc - 1) << 1, (8 + order) << 1)))
    c = np.flatnonzero(constant)
    out[body[c] + 1] = x[c, 0] & 0xFF
    v = np.flatnonzero(verbatim)
    out[(body[v] + 1)[:, None] + np.arange(BLOCK)] = x[v] & 0xFF
    r = np.flatnonzero(rice)
    if len(r):
        begin = 8 * (body[r] + 1)
        for j in range(int(order[r].max(initial=0))):
            some = r[order[r] > j]
            out[body[some] + 1 + j] = x[some, j] & 0xFF
        begin += _WARM * order[r]
        q = np.flatnonzero(is_lpc[r])
        if len(q):
            _put(out, begin[q] + 4, np.full(len(q), 11), 4)  # 12 bits a coefficient
            _put(out, begin[q] + 9, np.full(len(q), shift), 5)
            for j in range(lpc):
                _put(out, begin[q] + 9 + 12 * (j + 1), coefficients[r[q], j] & 0xFFF, 12)
        begin += extra[r]
        _put(out, begin + 6, np.full(len(r), PARTITION), 6)  # four-bit parameters
        begin += 6
        # Bit after each code: those before it and the parameters so far.
        ends = begin[:, None] + np.cumsum(bits[r], axis=1) + 4 * (np.arange(BLOCK)[None] // (BLOCK // parts) + 1)
        mask = coded[r]
        code = (1 << k[r]) | (u[r] & ((1 << k[r]) - 1))
        _put(out, ends[mask], code[mask], 9)
        starts = np.concatenate([begin[:, None] + 4, ends[:, BLOCK // parts - 1 : -1 : BLOCK // parts] + 4], axis=1)
        _put(out, starts.ravel(), param[r].ravel(), 4)
    if n:
        check = crc(out, at, size - 2, 16)
        out[at + size - 2], out[at + size - 1] = check >> 8, check & 0xFF

    raw, signed = out.tobytes(), (payload ^ 128).tobytes()
    streams = []
    for i, (f, m) in enumerate(zip(first.tolist(), frames.tolist(), strict=True)):
        own = size[f : f + m]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | m * BLOCK).to_bytes(8, "big") + hashlib.md5(signed[f * BLOCK : (f + m) * BLOCK]).digest()
        pointed = np.arange(0, m, -(-m // POINTS))
        points = np.empty(len(pointed), dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"], points["offset"], points["count"] = pointed * BLOCK, at[f + pointed] - at[f], BLOCK
        table = points.tobytes()
        stop = int(at[f + m - 1] + size[f + m - 1])
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + raw[int(at[f]) : stop])
    return streams


def _open(stream: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """Samples, MD5, place of the first frame, and the seek points' offsets."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, samples, digest, offsets = 4, -1, b"", np.zeros(0, dtype=np.int64)
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            word = int.from_bytes(block[10:18], "big")
            if (word >> 36 & 31) != 7 or (word >> 41 & 7) != 0 or struct.unpack(">HH", block[:4]) != (BLOCK, BLOCK):
                raise FlacError("only mono streams of 8-bit samples in blocks of 576 are read")
            samples, digest = word & ((1 << 36) - 1), block[18:34]
        elif kind & 0x7F == 3:
            points = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
            points = points[points["sample"] != (1 << 64) - 1]
            if len(points) and (points["sample"] == np.arange(len(points), dtype=np.uint64) * BLOCK).all():
                offsets = points["offset"].astype(np.int64)
        at += 4 + size
        if kind & 0x80:
            break
    if samples < 0 or samples % BLOCK:
        raise FlacError("no usable STREAMINFO")
    return samples, digest, at, offsets


def _frames(data: np.ndarray, start: np.ndarray, limit: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the frames that begin at ``start`` and end by ``limit``, and where they end."""
    n = len(start)
    longest = int((limit - start).max())
    m = data[np.minimum(start[:, None] + np.arange(longest + 10), len(data) - 1)]
    if (m[:, :4] != _HEAD).any():
        raise FlacError("no frame header")
    lead = m[:, 4]
    utf_size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC)
    head = 4 + utf_size
    value = np.where(utf_size == 1, lead, lead & (0x7F >> utf_size)).astype(np.int64)
    for k in range(1, int(utf_size.max())):
        value = np.where(utf_size > k, value << 6 | (m[:, 4 + k] & 0x3F), value)
    if (value != number).any() or (crc(data, start, head, 8) != m[np.arange(n), head]).any():
        raise FlacError("a frame header is damaged")
    head = head + 1
    kind = m[np.arange(n), head] >> 1
    if (m[np.arange(n), head] & 0x81).any():
        raise FlacError("wasted bits or a reserved bit")
    x = np.zeros((n, BLOCK), dtype=np.int32)
    end = np.zeros(n, dtype=np.int64)

    c = np.flatnonzero(kind == 0)
    x[c] = m[c, head[c] + 1].view(np.int8)[:, None]
    end[c] = head[c] + 2
    v = np.flatnonzero(kind == 1)
    x[v] = m[v[:, None], (head[v] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    end[v] = head[v] + 1 + BLOCK
    r = np.flatnonzero(kind >= 8)
    if len(c) + len(v) + len(r) < n or ((kind > 12) & (kind < 32)).any():
        raise FlacError("a reserved subframe")
    for a in range(0, len(r), 1024):
        own = r[a : a + 1024]
        x[own], end[own] = _rice(m[own], head[own] + 1, kind[own])
    size = end + 2
    if (start + size > limit).any():
        raise FlacError("a frame is cut")
    found = m[np.arange(n), end].astype(np.int64) << 8 | m[np.arange(n), end + 1]
    if (crc(data, start, end, 16) != found).any():
        raise FlacError("a frame is damaged")
    return x, start + size


def _rice(m: np.ndarray, head: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of subframes with a predictor, and the byte after each; a step decodes one residual of every frame."""
    n, width = m.shape
    bits = np.unpackbits(m, axis=1)
    total = bits.shape[1]
    # Place of the next one, and the 16 bits that follow each place.
    place = np.where(bits, np.arange(total, dtype=np.int32), np.int32(total - 1))
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1].ravel()
    wide = np.zeros((n, width + 3), dtype=np.uint32)
    wide[:, :width] = m
    three = (wide[:, :width] << 16 | wide[:, 1 : width + 1] << 8 | wide[:, 2 : width + 2]).ravel()
    base, row = np.arange(n) * total, np.arange(n) * width

    def take(at: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """Numbers of up to 16 bits from ``at`` on."""
        at = np.minimum(at, total - 1)
        word = three[row + (at >> 3)].astype(np.int64)
        return word >> (24 - count - (at & 7)) & ((1 << count) - 1) if np.isscalar(count) else (word << (at & 7) & 0xFFFFFF) >> (24 - count)

    is_lpc = kind >= 32
    order = np.where(is_lpc, kind.astype(np.int64) - 31, kind.astype(np.int64) - 8)
    x = np.zeros((n, BLOCK), dtype=np.int32)
    for j in range(int(order.max())):
        some = order > j
        x[some, j] = m[np.flatnonzero(some), head[some] + j].view(np.int8)
    at = 8 * (head + order)
    factor = np.zeros((n, int(order.max())), dtype=np.int64)
    shift = np.zeros(n, dtype=np.int64)
    for o in range(1, 5):
        factor[np.flatnonzero(~is_lpc & (order == o))[:, None], np.arange(o)] = _FIXED[o]
    if is_lpc.any():
        precision = np.where(is_lpc, take(at, 4) + 1, 0)
        shift = np.where(is_lpc, take(at + 4, 5), 0)
        if (precision == 16).any() or (shift >= 16).any():
            raise FlacError("a predictor is damaged")
        at = at + np.where(is_lpc, 9, 0)
        for j in range(factor.shape[1]):
            some = is_lpc & (order > j)
            raw = take(at, np.where(some, precision, 0))
            factor[some, j] = np.where(raw >> np.maximum(precision - 1, 0) & 1, raw - (1 << precision), raw)[some]
            at = at + np.where(some, precision, 0)
    method, partition = take(at, 2), take(at + 2, 4)
    if (method > 1).any() or (partition > 6).any():
        raise FlacError("a residual is damaged")
    at = at + 6
    step = BLOCK >> partition
    k = np.zeros(n, dtype=np.int64)
    steps = set(np.unique(step).tolist())
    least = int(order.min())
    for i in range(BLOCK):
        if any(i % s == 0 for s in steps):
            new = i % step == 0
            size = 4 + method
            got = take(at, size)
            k = np.where(new, got, k)
            if (new & (got == (1 << size) - 1)).any():
                raise FlacError("unencoded residuals are not read")
            at = at + np.where(new, size, 0)
        if i < least:
            continue
        here = np.minimum(at, total - 1)
        one = following[base + here]
        u = (one - here) << k | take(one + 1, k)
        now = order <= i
        value = u >> 1 ^ -(u & 1)
        x[:, i] = np.where(now, value, x[:, i])
        at = np.where(now, one + 1 + k, at)
    for o in range(1, 3):
        # Sums undo the differences of orders 1 and 2; the others are predicted sample by sample.
        some = np.flatnonzero(~is_lpc & (order == o))
        if len(some):
            y = x[some]
            if o == 2:
                y[:, 1] -= y[:, 0]
                y[:, 1:] = np.cumsum(y[:, 1:], axis=1)
            x[some] = np.cumsum(y, axis=1)
    slow = np.flatnonzero(is_lpc | (order > 2))
    if len(slow):
        y, f, o, s = x[slow].astype(np.int64), factor[slow], order[slow], shift[slow]
        for i in range(int(o.min()), BLOCK):
            guess = np.zeros(len(slow), dtype=np.int64)
            for j in range(min(i, f.shape[1])):
                guess += f[:, j] * y[:, i - 1 - j]
            y[:, i] += np.where(o <= i, guess >> s, 0)
        x[slow] = y
    return x, (at + 7) >> 3


def decode(streams: list[bytes], check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The payload bytes of all streams one after the other, and the number of blocks of each."""
    opened = [_open(s) for s in streams]
    blocks = np.array([o[0] // BLOCK for o in opened], dtype=np.int64)
    data = np.frombuffer(b"".join(streams) + bytes(16), dtype=np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    begin = np.array([o[2] for o in opened], dtype=np.int64) + ends - [len(s) for s in streams]
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), BLOCK), dtype=np.int32)
    known = np.array([len(o[3]) == b for o, b in zip(opened, blocks, strict=True)], dtype=bool)
    if known.any():
        own = np.flatnonzero(known)
        start = np.concatenate([opened[i][3] + begin[i] for i in own])
        limit = np.concatenate([np.r_[opened[i][3][1:] + begin[i], ends[i]] for i in own])
        to = np.concatenate([first[i] + np.arange(blocks[i]) for i in own])
        number = np.concatenate([np.arange(blocks[i]) for i in own])
        for a in range(0, len(start), 4096):
            part = slice(a, a + 4096)
            if (start[part] >= limit[part]).any() or (limit[part] - start[part] > 4 * BLOCK).any():
                raise FlacError("a seek point is wrong")
            out[to[part]], stop = _frames(data, start[part], limit[part], number[part])
            if (stop != limit[part]).any():
                raise FlacError("bytes between frames")
    for i in np.flatnonzero(~known):
        at = begin[i : i + 1]
        for k in range(blocks[i]):
            out[first[i] + k], at = _frames(data, at, np.minimum(ends[i : i + 1], at + 4 * BLOCK), np.array([k]))
        if at[0] != ends[i]:
            raise FlacError("bytes after the last frame")
    payload = (out + 128).astype(np.uint8).ravel()
    if check:
        signed = (payload ^ 128).tobytes()
        for i, (f, b) in enumerate(zip(first.tolist(), blocks.tolist(), strict=True)):
            if hashlib.md5(signed[f * BLOCK : (f + b) * BLOCK]).digest() != opened[i][1]:
                raise FlacError("the samples' MD5 differs")
    return payload, blocks


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """Payload bytes ``first`` to ``first + count`` by way of the seek table: only their frames are decoded."""
    samples, _, begin, offsets = _open(stream)
    first, stop = max(0, min(first, samples)), max(0, min(first + count, samples))
    if first >= stop:
        return b""
    if len(offsets) * BLOCK != samples:
        return decode([stream])[0].tobytes()[first:stop]
    a, b = first // BLOCK, -(-stop // BLOCK)
    data = np.frombuffer(stream + bytes(16), dtype=np.uint8)
    start = offsets[a:b] + begin
    limit = np.r_[offsets[a + 1 : b + 1] + begin, len(stream)][: b - a]
    x, _ = _frames(data, start, limit, np.arange(a, b))
    return (x + 128).astype(np.uint8).tobytes()[first - a * BLOCK : stop - a * BLOCK]
