"""Each registered query against the same rows from DuckDB."""

import datetime
import decimal

import pytest

from lodeweave import queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in queries.ORACLE_SQL:
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in place] for r in want.fetchall())


def test_flagship_plan(spark):
    plan = queries.QUERIES["federated_join_group_sum_topn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodeweave.streaming import windows

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.transformed(stream, [{"op": "filter", "column": "value", "min": 0}], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("value >= 0").count()
    assert windows.tumbling(stream, "ts", "1 hour", ["event_type"], {"n": F.count("*")}).isStreaming
