"""Engine, sources, joins, checks and log."""

import sqlite3

import pytest

from lodeweave.engine import Config, Engine
from lodeweave.operators import docpipe
from lodeweave.operators.merge import MergeError, Pair, merge
from lodeweave.plans import discovery, guard, spec
from lodeweave.plans.registry import JoinRegistry, JoinRule, recorded
from lodeweave.sources.profile import Table, columns_of
from lodeweave.verify import plausibility


@pytest.fixture()
def engine(spark, tmp_path):
    c = Config(schema_cache_path=str(tmp_path / "schema"), join_rules_path=str(tmp_path / "joins"), audit_log_path=str(tmp_path / "audit"), default_row_limit=100)
    e = Engine(spark, c)
    orders = spark.createDataFrame([(i, i % 10 + 1, i * 100.0) for i in range(1, 51)], "id long, customer_id long, amount double")
    customers = spark.createDataFrame([(i, f"Customer {i}", f"c{i}@example.com") for i in range(1, 11)], "id long, name string, email string")
    e.catalog.register("db_a", "frames", frames={"orders": orders})
    e.catalog.register("db_b", "frames", frames={"customers": customers})
    return e


def test_single_source(engine):
    r = engine.query("SELECT * FROM orders", ["db_a"])
    assert (r.row_count, r.truncated, r.columns) == (50, False, ["id", "customer_id", "amount"])
    r = engine.query("SELECT * FROM orders", ["db_a"], row_limit=3)
    assert (r.row_count, r.truncated) == (3, True)
    assert engine.query("SELECT * FROM orders", ["db_a"], row_limit=50).truncated is False
    r = engine.query("SELECT customer_id, count(*) AS n FROM orders GROUP BY customer_id LIMIT 5", ["db_a"])
    assert r.row_count == 10
    assert "error" not in r.envelope() and r.envelope()["row_count"] == 10


def test_federated(engine):
    q = {"sub_queries": [{"db": "db_a", "query": "SELECT customer_id, amount FROM orders", "key": "o"}, {"db": "db_b", "query": "SELECT id, name FROM customers", "key": "c"}], "join_on": [["o.customer_id", "c.id"]], "transform": [{"op": "group_sum", "group_by": "c__name", "value": "amount"}, {"op": "top_n_with_ties", "column": "sum_amount", "n": 1}]}
    r = engine.query(q)
    assert r.row_count == 1 and r.rows[0]["sum_amount"] == max(sum(i * 100.0 for i in range(1, 51) if i % 10 + 1 == k) for k in range(1, 11))
    assert r.provenance["db_key_map"] == {"o": "db_a", "c": "db_b"}
    assert engine.plan(q)["explain"]


def test_errors(engine):
    assert engine.query("DROP TABLE orders", ["db_a"]).error_type == "safety_violation"
    assert engine.query("SELECT * FROM orders", ["gone"]).error_type == "planning_error"
    assert engine.query("SELECT nope FROM orders", ["db_a"]).error_type == "execution_error"
    assert engine.query("SELECT 1 AS x", ["db_a"], session_id="s").error is None
    assert engine.query("SELECT  1 AS X", ["db_a"], session_id="s").error
    engine.reset_session("s")
    assert engine.query("SELECT 1 AS x", ["db_a"], session_id="s").error is None
    engine.config.max_cost_bytes = 0
    assert engine.query("SELECT * FROM orders", ["db_a"]).error_type == "cost_overrun"


def test_audit_schema_connections(engine):
    engine.query("SELECT 1 AS x", ["db_a"], session_id="t")
    entry, = engine.audit(session_id="t")
    assert entry["row_count"] == 1 and engine.audit(replay_id=entry["id"])["query"] == "SELECT 1 AS x"
    assert engine.schema()["db_a"]["orders"] == {"columns": 3, "row_count": 50}
    assert engine.scanner.diff("db_a") == []
    engine.catalog.sources["db_a"].frames.clear()
    engine.catalog.sources["db_a"].frames["other"] = engine.spark.range(1)
    assert engine.scanner.diff("db_a") == ["orders", "other"]
    assert {c["status"] for c in engine.connections()} == {"connected"}


def test_rules(spark, tmp_path, engine):
    rule = JoinRule("db_a", "orders", "customer_id", "db_b", "customers", "id", "identity", 0.8)
    assert recorded(rule, True).confidence == 0.82 and recorded(rule, False).confidence == 0.75
    engine.registry.save(rule)
    assert engine.registry.find_for_tables("db_b", "customers", "db_a", "orders")[0].column_a == "id"
    q = {"sub_queries": [{"db": "db_a", "query": "SELECT * FROM orders", "key": "o"}, {"db": "db_b", "query": "SELECT * FROM customers", "key": "c"}]}
    assert "no join" in " ".join(engine.query(q).warnings)
    engine.joins(confirm=rule.join_id)
    r = engine.query(q)
    assert r.row_count == 50 and r.rows[0]["c__name"] and engine.registry.get(rule.join_id).success_count == 1
    again = JoinRegistry(spark, str(tmp_path / "joins"))
    assert again.get(rule.join_id).confirmed
    assert again.reject(rule.join_id) and JoinRegistry(spark, str(tmp_path / "joins")).get_all() == []


def test_discovery(spark, engine):
    d = discovery
    assert d.detect_transform(spark, ["10001", "10002", "10003"], ["10001", "10002", "10003", "4"])[0] == "identity"
    assert d.detect_transform(spark, [10001, 10002], ["10001", "10002"])[0] == "identity"
    assert d.detect_transform(spark, ["AAA", "BBB", "CCC"], ["111", "222", "333"])[0] is None
    assert d.detect_transform(spark, [], ["1"]) == (None, 0.0)
    schema = {a: {t: Table(t, columns_of(engine.catalog.table(a, t))) for t in engine.catalog.tables(a)} for a in ("db_a", "db_b")}
    assert any(c.a[2] == "id" and c.b[2] == "id" for c in d.JoinDiscovery(engine.catalog).discover(schema))
    a = spark.createDataFrame([(f"CUST-{i:07d}", i * 1.5) for i in range(30)], "k string, v double")
    b = spark.createDataFrame([(f"cust{i:07d}", "x") for i in range(30)], "c string, z string")
    assert d.detect_join(a, b).transform in ("extract_digits", "zfill_5", "zfill_7")


def test_guard(spark):
    for q in ("", "SELECT 1", "WITH t AS (SELECT 1 AS a) SELECT a FROM t", '{"collection": "x"}', "SELECT a.x FROM (SELECT 1 AS x) a JOIN (SELECT 1 AS x) b ON a.x = b.x ORDER BY 1 LIMIT 3"):
        assert guard.is_safe(spark, q), q
    for q, kind in (("INSERT INTO t VALUES (1)", "WRITE_OPERATION"), ("UPDATE t SET a = 1", "WRITE_OPERATION"), ("DELETE FROM t", "WRITE_OPERATION"), ("CREATE TABLE t (a INT)", "DDL_OPERATION"), ("SELECT 1; SELECT 2", "MULTIPLE_STATEMENTS"), ("SELEC", "PARSE_ERROR"), ("SELECT reflect('java.lang.System', 'exit', 0)", "DDL_OPERATION"), ('{"collection": "x", "pipeline": [{"$out": "y"}]}', "WRITE_OPERATION"), ("FROM t INSERT INTO a SELECT 1 INSERT INTO b SELECT 2", "WRITE_OPERATION")):
        with pytest.raises(guard.SafetyViolation) as e:
            guard.check(spark, q)
        assert e.value.kind == kind, q


def test_merge(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, x string")
    right = spark.createDataFrame([("1", 1), ("1", 2), ("9", 3)], "k string, y int")
    got = merge({"l": left, "r": right}, [Pair.parse("l.id", "r.k")])
    assert got.columns == ["id", "x", "r__k", "r__y"] and got.count() == 2
    empty = right.limit(0)
    assert merge({"l": left, "r": empty}, [Pair.parse("l.id", "r.k")]).count() == 0
    assert merge({"l": left, "r": empty}, [Pair.parse("l.id", "r.k")], empty_right="passthrough").count() == 3
    with pytest.raises(MergeError):
        merge({"l": left}, [Pair.parse("l.id", "gone.k")])
    with pytest.raises(MergeError):
        Pair.parse("l", "r.k")


def test_spec():
    inner = '{"db": "a", "query": "SELECT 1", "key": "k"}'
    for found in ([inner], f"[{inner}]", inner):
        assert spec.parse({"sub_queries": found}, ["a"]).sub_queries[0].key == "k"
    with pytest.raises(spec.SpecError):
        spec.parse({"sub_queries": [{"db": "zz", "query": "x"}]}, ["a"])
    with pytest.raises(spec.SpecError):
        spec.parse({"sub_queries": "nonsense"}, ["a"])


def test_plausibility():
    schema = {"mydb": {"orders": Table("orders", row_count=5000)}}
    assert plausibility([], "select * from orders", schema).failure_mode == "wrong_join_key"
    assert plausibility([], "select 1", schema).score == 0.6
    from lodeweave.sources.profile import Column

    schema["mydb"]["orders"].columns = [Column("amount", "double", p95=10)]
    assert plausibility([{"amount": 20.0}], "", schema).score == 1.0
    assert plausibility([{"amount": 999.0 * i} for i in range(1, 8)], "", schema).score == 0.5


def test_document_pipelines(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [])], "k string, l array<int>")
    assert docpipe.run(df, '[{"$unwind": "$l"}, {"$group": {"_id": "$k", "s": {"$sum": "$l"}}}]').collect() == [("a", 3)]
    assert docpipe.run(df, [{"$match": {"k": {"$in": ["b"]}}}, {"$count": "n"}]).first()["n"] == 1
    with pytest.raises(docpipe.PipelineError):
        docpipe.run(df, [{"$out": "x"}])


def test_embedded_sources(engine, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (a integer, b text, c real)")
        c.executemany("insert into t values (?, ?, ?)", [(i, f"s{i}", i / 2) for i in range(100)])
    engine.catalog.from_uris([f"sqlite://{path}"])
    assert engine.catalog.tables("sqlite") == ["t"]
    r = engine.query("SELECT sum(a) AS s, max(b) AS m FROM t WHERE a >= 10", ["sqlite"])
    assert r.rows == [{"s": sum(range(10, 100)), "m": "s99"}]
    import duckdb

    path = str(tmp_path / "y.duckdb")
    with duckdb.connect(path) as c:
        c.execute("create table u as select range as a, 'v' || range as b from range(50)")
    engine.catalog.register("duck", "duckdb", path)
    assert engine.query("SELECT count(*) AS n, min(b) AS b FROM u", ["duck"]).rows == [{"n": 50, "b": "v0"}]


def test_math_and_context(engine):
    rows = [{"g": "a", "t": 1, "v": 1.0}, {"g": "a", "t": 2, "v": 3.0}]
    assert engine.math_compute(rows=rows, expression={"m": "avg(v)"}) == [{"m": 2.0}]
    assert engine.math_compute(rows=rows, operation="ema", group_col="g", sort_col="t", value_col="v", alpha=0.5)[0]["ema"] == 2.0
    assert "db_a.orders(" in engine.context("db_a")


def test_guard_knows_tables(spark):
    for q in ("SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM a WHERE x IN (SELECT y FROM csv.`/etc`)", "SELECT * FROM hidden", "SELECT (SELECT max(x) FROM hidden) AS m FROM a", "SELECT * FROM a, LATERAL (SELECT * FROM spark_catalog.default.b)"):
        with pytest.raises(guard.SafetyViolation) as e:
            guard.check(spark, q, ["a"])
        assert e.value.kind == "UNKNOWN_TABLE", q
    guard.check(spark, "WITH t AS (SELECT x FROM A) SELECT * FROM t JOIN a USING (x) WHERE x > (SELECT min(x) FROM T)", ["a"])


def test_windows_keep_the_row_cap(engine):
    r = engine.query("SELECT id, row_number() OVER (ORDER BY id) AS k FROM orders", ["db_a"], row_limit=4)
    assert (r.row_count, r.truncated) == (4, True)
    r = engine.query("SELECT id FROM orders WHERE amount > (SELECT avg(amount) FROM orders)", ["db_a"], row_limit=4)
    assert (r.row_count, r.truncated) == (4, True)


def test_specs_teach_joins(engine):
    q = {"sub_queries": [{"db": "db_a", "query": "SELECT customer_id AS who, amount FROM orders", "key": "o"}, {"db": "db_b", "query": "SELECT id, name FROM customers", "key": "c"}], "join_on": [["o.who", "c.id"]]}
    assert engine.query(q).row_count == 50
    rule, = engine.registry.get_all()
    assert (rule.table_a, rule.column_a, rule.table_b, rule.column_b, rule.confidence, rule.confirmed) == ("orders", "customer_id", "customers", "id", 0.65, False)
    engine.query(q)
    assert engine.registry.get(rule.join_id).confidence == 0.67
    engine.registry.save(JoinRule("db_a", "orders", "amount", "db_b", "customers", "name", "identity", 0.9, True))
    found = {r["column_a"]: r for r in engine.verify_rules()}
    assert found["customer_id"]["confidence"] >= 0.65 and found["amount"]["confidence"] < 0.6 and not found["amount"]["confirmed"]


def test_detected_joins_and_json_fields(engine):
    spark = engine.spark
    engine.catalog.register("x", "frames", frames={"a": spark.createDataFrame([(f"CUST-{i:04d}", i * 1.5) for i in range(40)], "k string, v double")})
    engine.catalog.register("y", "frames", frames={"b": spark.createDataFrame([(f'{{"ref": "cust{i:04d}", "n": {i % 3}}}',) for i in range(40)], "doc string")})
    q = {"sub_queries": [{"db": "x", "query": "SELECT * FROM a", "key": "a"}, {"db": "y", "query": "SELECT * FROM b", "key": "b"}]}
    assert engine.query(q).warnings
    r = engine.query(q, detect=True)
    assert r.row_count == 40 and r.provenance["merge_on"] == [["a.k", "b.doc__ref"]]


def test_jdbc(engine, tmp_path):
    spark = engine.spark
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    spark.range(100).selectExpr("cast(id as int) AS ID", "id * 2 AS V").write.jdbc(url, "ITEMS", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    engine.catalog.register("j", "jdbc", url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="ID", numPartitions="4")
    assert engine.catalog.tables("j") == ["ITEMS"]
    assert engine.catalog.table("j", "ITEMS").rdd.getNumPartitions() == 4
    assert engine.query("SELECT sum(V) AS s FROM ITEMS", ["j"]).rows == [{"s": 9900}]


def test_uris():
    from lodeweave.sources.catalog import credentials, parse_uri

    uri = "postgresql://u:p%40w@h:5433/db?sslmode=require"
    assert parse_uri(uri) == ("jdbc", "jdbc:postgresql://h:5433/db?sslmode=require") and credentials(uri) == {"user": "u", "password": "p@w"}
    assert parse_uri("mysql://h/db") == ("jdbc", "jdbc:mysql://h:3306/db") and credentials("sqlite:///x") == {}


def test_zero_total(engine):
    with pytest.raises(ValueError, match="zero"):
        engine.math_compute(rows=[{"a": "x", "b": "y", "count": 0}], operation="chi_square", row_col="a", col_col="b")


def test_context_manager(engine):
    with engine as e:
        assert e.connections()
    assert not engine.catalog.sources
