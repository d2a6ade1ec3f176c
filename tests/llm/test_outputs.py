"""What the registered queries return, recomputed row by row in plain Python."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodeweave.llm import common, flac, op1_toxicity, op5_bpe, op8_quality, registry, words

from .test_exact import components, fingerprint, library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: t or "" for i, t in zip(table["doc_id"], table["text"], strict=True)}


def rows(spark, name):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, SF).collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_tokens(spark, texts):
    own, got = library(), rows(spark, "op5_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(own.decode(ids, skip_special_tokens=False).encode()))


def test_media(spark, texts):
    got = rows(spark, "op7_flac")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        b, r = t.encode(), got[i]
        payload = b + b"\xff" * (-len(b) % 576 if b else 576)
        stream = flac.encode(np.frombuffer(payload, dtype=np.uint8), np.array([len(payload) // 576]))[0]
        x = [v - 128 for v in payload]
        power, n = sum(v * v for v in x), len(x)
        feature = f"blocks={n // 576};rms={math.sqrt(power / n):.4f};crossings={sum((a >= 0) != (c >= 0) for a, c in zip(x, x[1:]))};step={sum(abs(a - c) for a, c in zip(x, x[1:])) / n:.4f}"
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stream), sha(stream), feature)


def test_seek_points_of_long_streams(monkeypatch):
    payload = np.frombuffer(b"many frames " * 2400, dtype=np.uint8)
    monkeypatch.setattr(flac, "POINTS", 7)
    stream = flac.encode(payload, np.array([len(payload) // 576]))[0]
    back, blocks = flac.decode([stream])
    assert back.tobytes() == payload.tobytes() and flac.read_samples(stream, 600, 2000) == payload.tobytes()[600:2600]


def test_near_duplicates(spark, texts):
    got = rows(spark, "op9_simhash")
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root, least = components(set(prints.values())), {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_packing(spark, texts):
    own = library()
    found, held = registry.QUERIES["op10_packing"](spark, SF).collect(), defaultdict(list)
    want = {}
    for i, t in texts.items():
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes()))
    assert len(found) == len(want) and {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity(spark, texts):
    """The scores of the fitted weights, by sets of buckets."""
    got = rows(spark, "op1_toxicity")
    model = op1_toxicity.train(common.read(spark, SF, "documents"), common.read(spark, SF, "labels"))
    weight = dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True))
    for i, t in texts.items():
        keys = op1_toxicity.unique_buckets(*words.flat(pa.array([t])))[0].tolist()
        score = 1 / (1 + math.exp(-(sum(weight.get(k, 0.0) for k in keys) + model.bias)))
        assert got[i]["score"] == pytest.approx(score, abs=1e-4) and got[i]["held_out"] == held_out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_quality(spark, texts):
    got = rows(spark, "op8_quality")
    model = op8_quality.train(common.read(spark, SF, "documents"), common.read(spark, SF, "labels"))
    for i, t in texts.items():
        x = op8_quality.features(*words.flat(pa.array([t])))[0]
        z = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        wide = z + [max(a - k, 0.0) for j, a in enumerate(z) for k in model.knots[:, j]]
        s = sum(a * float(w) for a, w in zip(wide, model.weight, strict=True))
        score = 1 / (1 + math.exp(-(model.slope * (s - model.threshold) + math.log(0.7 / 0.3))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-3) and got[i]["held_out"] == held_out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_ftrl_step_by_step():
    """FTRL-proximal as published, one coordinate at a time."""
    rng = np.random.default_rng(2)
    data = [np.unique(rng.integers(0, 64, 9)) for _ in range(200)]
    y = np.array([int(3 in x or 7 in x) for x in data])
    how = op1_toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=2)
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= how.l1 else -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)
    for _ in range(how.epochs):
        for x, label in zip(data, y, strict=True):
            w = {i: weight(i) for i in x.tolist()}
            b = -zb / ((how.beta + math.sqrt(nb)) / how.alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / how.alpha * b
            nb += g * g
    model = op1_toxicity.fit(data, y, bits=6, how=how)
    assert dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in range(64) if abs(z[i]) > how.l1})


def test_pairwise_loss_is_at_its_least():
    """The gradient of the logistic loss of the drawn pairs' differences is about zero at the fit."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, len(op8_quality.FEATURES)))
    good = x[:, 0] + 0.5 * rng.normal(size=300) > 0
    model = op8_quality.fit(x, good, pairs=2000, rounds=3000, penalty=0.05)
    draw = np.random.default_rng(7)
    win, lose = draw.choice(np.flatnonzero(good), 2000), draw.choice(np.flatnonzero(~good), 2000)
    wide = op8_quality._expand(x, model)
    w = model.weight.astype(float)
    gradient = 0.05 * w
    for a, b in zip(win, lose, strict=True):
        d = wide[a] - wide[b]
        gradient -= d / (1 + math.exp(d @ w)) / 2000
    assert np.abs(gradient).max() < 1e-3
