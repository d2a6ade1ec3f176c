"""Queries over the whole of their tables."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodeweave import queries
from lodeweave.plans import discovery

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("orders", "lineitem", "nation"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["ema_full", "ema_summarize_gapfill"])
def test_ema_counts_every_order(spark, duck, name):
    months = "select o_orderpriority as g, (year(o_orderdate) * 12 + month(o_orderdate))::bigint as s, count(*) as v from orders group by 1, 2"
    want = {(g, s): v for g, s, v in duck.sql(months).fetchall()}
    got = {(r["g"], r["s"]): (r["v"], r["ema"]) for r in queries.QUERIES[name](spark, SF).collect()}
    ema = {}
    for g in {g for g, _ in want}:
        of = [s for h, s in want if h == g]
        e = None
        for s in range(min(of), max(of) + 1):
            v = want.get((g, s), 0)
            e = v if e is None else 0.2 * v + 0.8 * e
            ema[g, s] = (v, e)
    if name == "ema_full":
        assert sum(v for v, _ in got.values()) == spark.read.parquet(f"{SF}/orders.parquet").count()
        assert got.keys() == ema.keys()
    else:
        assert {g: max(e for h, (_, e) in ((k[0], x) for k, x in ema.items()) if h == g) for g, _ in want} == {g: pytest.approx(e, abs=1e-3) for (g, _), (_, e) in got.items()}
    for k, (v, e) in got.items():
        assert v == ema[k][0] and e == pytest.approx(ema[k][1], abs=1e-3)


def test_range_join_takes_every_line(spark, duck):
    want = duck.sql("select l_orderkey, l_linenumber, n_nationkey from lineitem join nation on l_quantity >= n_nationkey * 2 and l_quantity < n_nationkey * 2 + 3").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.QUERIES["range_join"](spark, SF).collect())


def test_discover_joins_reads_every_value(spark, tmp_path):
    n = 220_000
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(n).select((n - 1 - F.col("id")).alias("c_custkey"), F.lit("x").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    found = {(r["a"], r["b"]): r for r in queries.QUERIES["discover_joins"](spark, str(tmp_path)).collect()}
    r = found["crm.customer.c_custkey", "sales.orders.o_custkey"]
    assert (r["transform"], r["overlap"]) == ("identity", 1.0)


def test_discover_joins_takes_no_shared_endings(spark, tmp_path):
    """Cut down to their endings, all customers are ordered; as keys, a sixth of them is."""
    spark.range(15_000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(90_000).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    found = [tuple(r) for r in queries.QUERIES["discover_joins"](spark, str(tmp_path)).collect()]
    assert found == [("sales.orders.o_custkey", "crm.customer.c_custkey", "identity", 1.0, 0.9475)]


def test_spellings_of_a_key_stay_one(spark):
    detect = discovery.detect_transform
    assert detect(spark, ["AB", "ab", "Ab", "CD"], ["ab", "cd"]) == ("lowercase", 1.0)
    assert detect(spark, ["x-1", "x_1", "y-2"], ["x1", "y2"]) == ("remove_separators", 1.0)
    assert detect(spark, ["1", "01", "2"], ["00001", "00002"]) == ("zfill_5", 1.0)
    assert detect(spark, ["de-1", "fr-1", "it-1"], ["1"])[0] is None


def customers(spark, path, ids):
    for t in "region nation supplier part orders lineitem events documents pages conversations".split():
        (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rows = [(i, f"Customer#{i:09d}", i % 25, float(i), "S") for i in ids]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(str(path / "customer.parquet"))


def test_zfill_joins_take_long_ids(spark, tmp_path):
    customers(spark, tmp_path, [1, 2, 100_001, 1_000_002, 10_000_001])
    rows = lambda name: sorted((r["x"], r["b__y"]) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert rows("join_zfill_5") == [(1, "00001")] * 3 + [(2, "00002")] * 2
    assert rows("join_zfill_7") == [(1, "0000001")] * 2 + [(2, "0000002"), (100_001, "0100001"), (1_000_002, "1000002")]
    r = queries.QUERIES["key_grammar"](spark, str(tmp_path)).first()
    assert (r["rows"], r["keys"]) == (5, 5)


def test_lateral_limit_keeps_its_order(spark, duck, tmp_path):
    for t in "region nation supplier part customer lineitem events documents pages conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rows = [(2, 1, 5.0), (None, 1, 5.0), (7, 2, None), (8, 2, 1.0), (None, 3, 2.0), (4, 3, 1.0), (9, 4, None), (6, 4, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").selectExpr("*", "'F' as o_orderstatus", "timestamp'2000-01-01' as o_orderdate", "'x' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    df = queries.QUERIES["sql_lateral_subquery"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 2), (2, 8), (3, None), (4, 6)]
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Window [" in x]
    assert windows and all("o_totalprice" in x and "DESC" in x for x in windows)


def test_jdbc_rows_of_any_text(spark, tmp_path):
    rows = [(i, b, i) for i, b in enumerate([None, "", " a ", 'x"y', '"', "a,b", "l\nm", "é😀", "z" * 70, "\\", "\r\n"])] + [(-5, "q", None), (1 << 40, "q", 7)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, queries.QUERIES["source_jdbc_ranges"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(b, 1, i) for i, b, _ in rows[:-2]] + [("q", 2, 7)], key=repr)
    spark.createDataFrame([], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "none" / "part.parquet"))
    assert queries.QUERIES["source_jdbc_ranges"](spark, str(tmp_path / "none")).collect() == []


def test_jdbc_with_separate_executors(tmp_path):
    code = f"""
from lodeweave import queries
from lodeweave.session import session
s = session("t", "local-cluster[2,1,1024]", **{{"spark.ui.enabled": "false", "spark.sql.warehouse.dir": "{tmp_path}/warehouse", "spark.driver.memory": "1g"}})
print("rows", queries.QUERIES["source_jdbc_ranges"](s, "{SF}").groupBy().sum("n").first()[0])
s.stop()
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    assert "rows 200" in run.stdout, run.stderr[-2000:]
