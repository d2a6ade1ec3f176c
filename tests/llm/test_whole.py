"""Operators on inputs that a cut would lose."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import common, op2_secrets, op4_dedup, op6_licenses, op8_quality, words

from .test_exact import frame, repeated

SEVERAL = [
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nCopyright, all rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted.\nLicensed under the Apache License, Version 2.0.",
]


def test_licenses_of_a_file_with_several(spark):
    # Other files make every licence word about equally frequent, as in a corpus.
    texts = [*SEVERAL, *(passage for passage, _ in op6_licenses.TEMPLATES.values())]
    found = {r["doc_id"]: r["found"] for r in op6_licenses.scan(frame(spark, texts)).collect()}
    assert {x["label"] for x in found[0]} == {"gpl-3.0", "apache-2.0", "cc-by-nc-4.0", "mit-release", "all-rights"}
    assert {x["label"] for x in found[1]} == {"bsd", "apache-2.0"}
    assert all(0 < x["score"] <= 1 for r in found.values() for x in r)
    assert all(len({(x["label"], x["start"]) for x in r}) == len(r) for r in found.values())
    for i, t in enumerate(op6_licenses.TEMPLATES):
        assert (t, 0) in {(x["label"], x["start"]) for x in found[2 + i]}


def test_long_tokens_beside_an_identifier_are_linked(spark):
    tokens = ["aB3" * 22, "Zk9/" * 22, "qW7_" * 500]
    texts = [f"account_id = acme-main then {t} end" for t in tokens] + [f"plain {tokens[0]} end"]
    rows = {r["doc_id"]: r for r in op2_secrets.scan(frame(spark, texts)).collect()}
    kinds = {i: [(op2_secrets.KINDS[s["kind"]], s["end"] - s["start"]) for s in r["linked"]] for i, r in rows.items()}
    assert [dict(kinds[i]).get("token") for i in range(4)] == [66, 88, 2000, None]
    clean = {r["doc_id"]: r["text"] for r in op2_secrets.redact(frame(spark, texts)).collect()}
    assert all(t not in clean[i] for i, t in enumerate(tokens)) and clean[3] == texts[3]


def test_quality_threshold_is_over_all_labels(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "Beta.", "x", "!!", "of", "|"], rng.integers(1, 60))) for _ in range(500)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(t.count("alpha") > t.count("|"))) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = op8_quality.train(docs, labels, sample=60, pairs=500)
    good = {r["doc_id"]: r["quality"] for r in labels.where(~common.held_out(F.col("doc_id"))).collect()}
    s = op8_quality._expand(op8_quality.features(*words.flat(pa.array([texts[i] for i in good], pa.string()))), model) @ model.weight
    assert model.threshold == pytest.approx(float(np.quantile(s, 1 - np.mean(list(good.values())))), abs=1e-6)


def test_licenses_of_a_file_with_all(spark):
    passages = [passage for passage, _ in op6_licenses.TEMPLATES.values()]
    texts = ["\n".join(passages), " and ".join(x.upper() for x in passages[::-1]), *passages]
    df = frame(spark, texts).withColumnsRenamed({"source": "W", "extra": "__t"}).withColumn("Found", F.lit(3))
    found = op6_licenses.scan(df)
    assert found.columns == ["doc_id", "text", "W", "__t", "n_words", "places", "found"]
    rows = {r["doc_id"]: r for r in found.collect()}
    for i in (0, 1):
        assert {x["label"] for x in rows[i]["found"]} == set(op6_licenses.TEMPLATES)
    assert all(max(x["score"] for x in r["found"]) == 1.0 for r in rows.values()) and rows[0]["W"] == "kept"


def test_licenses_of_an_empty_table(spark):
    assert op6_licenses.scan(frame(spark, ["a"]).limit(0)).count() == 0


def test_dedup_of_ids_that_are_no_integers_and_clashing_names(spark):
    passage = "a passage of words that comes again in another document and is longer than a hundred bytes, by some way " * 2
    rows = [("b", f"x {passage} y", 1, "r", 0), ("a", passage, 2, "s", 0), (None, passage, 3, "t", 0), ("c", None, 4, "u", 0)]
    df = spark.createDataFrame(rows, "name string, text string, doc int, row string, gone int")
    out = op4_dedup.dedup(df, doc_id="name")
    assert out.columns == ["name", "text", "doc", "row", "gone", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r["doc"]: r for r in out.collect()}
    first = repeated([("a", passage.encode()), ("b", f"x {passage} y".encode())])
    assert {r["name"]: r["n_removed"] for r in got.values()} == {"a": first["a"][1], "b": first["b"][1], None: 0, "c": 0}
    assert got[1]["row"] == "r" and got[4]["text"] is None and got[4]["kept"] == b""


def test_dedup_of_texts_of_megabytes(spark):
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefgh \n", dtype=np.uint8)
    big = rng.choice(letters, 2_300_000).tobytes().decode()
    again = big[1_048_000:1_049_500] + "-" + big[2_200_000:2_200_300]
    docs = [big, again, "short", "ab" * 700_000]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in op4_dedup.dedup(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {0: (2_300_000, 0, 0), 1: (1801, 1800, 2), 2: (5, 0, 0), 3: (1_400_000, 1_399_998, 1)}


def test_secrets_of_a_row_with_many_parts_and_clashing_names(spark):
    one = "login: user.name Zk9" + "aB3" * 12 + " https://host.example/x "
    text = (one * 3000 + "password = hunter22; ") + "é" * 70_000 + " token: " + "aB3" * 30_000 + " end"
    df = spark.createDataFrame([(1, text, "a", 2)], "row int, text string, strong string, t int")
    out = op2_secrets.scan(df)
    assert out.columns == ["row", "text", "t", "strong", "linked"]
    r = out.first()
    kinds = [op2_secrets.KINDS[s["kind"]] for s in r["linked"]]
    assert (kinds.count("identifier"), kinds.count("token"), kinds.count("endpoint")) == (3000, 3000, 3000)
    assert [text[s["start"] : s["end"]] for s in r["strong"]] == ["password = hunter22", "token: " + "aB3" * 30_000]
    clean = op2_secrets.redact(df).first()
    marks = "[secret] [secret] [secret] " * 3000
    assert clean["text"] == marks + "[secret]; " + "é" * 70_000 + " [secret] end" and clean["strong"] == "a"


def test_search_counts_repeated_ids_as_the_sql_does(spark):
    import duckdb
    import pyarrow as pa

    from lodeweave.llm import op3_topk

    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in rng.integers(0, 200, 400)]
    rows += [(7, rows[0][1]), (8, rows[0][1]), (8, rows[0][1]), (50, rows[0][1])]
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    c = duckdb.connect()
    c.register("embeddings", table)
    want = c.sql("select query_id, rank, vec_id, score from (" + op3_topk.ORACLE_SQL + ")").fetchall()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    data = df.select("vec_id", op3_topk.quantised("embedding").alias("v"))
    got = op3_topk.top_k(data, data.where("vec_id % 50 = 0"), 5, shard=64, block=3).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_leaves_out_most_distances_where_vectors_cluster():
    from lodeweave.llm.mtree import MTree

    rng = np.random.default_rng(4)
    centers = rng.integers(-800, 800, (40, 32))
    x = centers[rng.integers(0, 40, 6000)] + rng.integers(-20, 20, (6000, 32))
    tree = MTree(np.arange(6000), x, leaf=64, fan=16)
    for i in range(0, 6000, 300):
        found, score = tree.search(x[i], 5, own=i)
        s, ids = x @ x[i], np.arange(6000)
        order = np.lexsort((ids, -s))
        assert found.tolist() == order[order != i][:5].tolist()
    assert tree.computed < 0.25 * 20 * 6000
