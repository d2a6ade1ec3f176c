"""Classifiers: held-out accuracy, empty texts, equal texts."""

import numpy as np
import pyarrow as pa

from lodeweave.llm import op1_toxicity, op8_quality, words

rng = np.random.default_rng(11)
PLAIN = ["the", "house", "stands", "near", "river", "and", "people", "walk", "slowly", "home", "again", "every", "quiet", "morning"]


def text(n, bad=()):
    out = [str(w) for w in rng.choice(PLAIN, n)]
    for b in bad:
        out.insert(int(rng.integers(0, len(out) + 1)), b)
    return " ".join(out)


def test_hashes_depend_on_the_word_alone():
    raw, offsets = words.flat(pa.array(["Ab cd", None, "", "x cd AB"]))
    start, end, row = words.spans(raw, offsets)
    h = words.hashes(raw, start, end)
    assert row.tolist() == [0, 0, 3, 3, 3] and h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_toxicity_learns(spark):
    rows = [(i, text(40, ("idiot", "clown")[: 1 + i % 2]) if i % 4 == 0 else text(40), int(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (9002, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = op1_toxicity.train(docs, labels, how=op1_toxicity.Ftrl(l1=2.0))
    got = {r["doc_id"]: r["score"] for r in op1_toxicity.score(docs, model).collect()}
    assert len(got) == 803 and got[9000] == got[9001] and got[9002] == got[0]
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in held]) > 0.97
    empty = op1_toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in op1_toxicity.score(docs, empty).collect()} == {0.5}
    assert op1_toxicity.score(docs.limit(0), model).count() == 0


def test_quality_learns(spark):
    rows = [(i, text(60) if i % 5 else " ".join(w + "%%%" for w in text(60).split()), int(i % 5 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = op8_quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op8_quality.score(docs, model).collect()}
    assert got[9000] == got[9001] and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == y for i, _, y in rows]) > 0.98
    flat = op8_quality.train(docs, labels.limit(0))
    assert min(r["score"] for r in op8_quality.score(docs, flat).collect()) >= 0.7
