"""Registered queries that pass through the engine and its catalog, with the SQL that gives the same rows."""

import json
import os
import uuid
import zipfile
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Config, Engine
from .functions import keys, user
from .functions import sql as sql_functions
from .plans import discovery, guard
from .plans.registry import JoinRule
from .sources import catalog as catalogs
from .sources.profile import SchemaCache, SchemaScanner
from .verify import plausibility

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def _folder(spark: SparkSession) -> str:
    """A new folder in the warehouse, which goes when the application ends; embedded databases need it as a local path."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sources/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return urlsplit(path).path if path.startswith("file:") else path


def _derby(spark: SparkSession, df: DataFrame, table: str, columns: str) -> str:
    """The URL of a database that holds ``df`` and that every process can open.

    Only one process can have a database folder open, so the driver imports the rows, which the executors
    write as text, and closes it; in an archive it is for reading only, and then any number can. The archive
    is not compressed: pages are read by their place.
    """
    folder, manager = _folder(spark), spark._jvm.java.sql.DriverManager
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    field = lambda n: F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"')) if n in texts else F.col(n).cast("string")
    df.select(F.concat_ws(",", *(F.coalesce(field(n), F.lit("")) for n in df.columns))).write.text(f"{folder}/rows")
    connection = manager.getConnection(f"jdbc:derby:{folder}/base;create=true")
    run = connection.createStatement().execute
    run(f"create table {table} ({columns})")
    for name in sorted(n for n in os.listdir(f"{folder}/rows") if n.startswith("part-")):
        run(f"""call syscs_util.syscs_import_table(null, '{table}', '{folder}/rows/{name}', ',', '"', 'UTF-8', 0)""")
    connection.close()
    try:
        manager.getConnection(f"jdbc:derby:{folder}/base;shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # closing a database always raises this
            raise
    with zipfile.ZipFile(f"{folder}/base.jar", "w", zipfile.ZIP_STORED) as archive:
        for at, _, names in os.walk(f"{folder}/base"):
            for name in names:
                archive.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", folder))
    return f"jdbc:derby:jar:({folder}/base.jar)base"


def _engine(spark: SparkSession, sf: str, **config) -> Engine:
    """An engine with the tables as the source ``files`` and state of its own."""
    state = _folder(spark)
    e = Engine(spark, Config(schema_cache_path=f"{state}/schema", join_rules_path=f"{state}/joins", audit_log_path=f"{state}/audit", **config))
    e.catalog.register("files", "parquet", sf)
    return e


def _sub(key: str, sql: str | dict, db: str = "files") -> dict:
    return {"db": db, "query": sql, "key": key}


def _state(spark: SparkSession, *rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# -- sources ------------------------------------------------------------------


@query("SELECT c.c_mktsegment, n.n_name AS n__n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 GROUP BY 1, 2")
def source_sqlite(spark, sf):
    import sqlite3

    path = f"{_folder(spark)}/base.db"
    with sqlite3.connect(path) as base:
        base.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        base.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()])
    e = _engine(spark, sf)
    e.catalog.from_uris([f"sqlite:///{path}"])
    df, _ = e.frame({"sub_queries": [_sub("c", "SELECT c_nationkey, c_mktsegment FROM customer"), _sub("n", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", "sqlite")], "join_on": [["c.c_nationkey", "n.n_nationkey"]]})
    return df.groupBy("c_mktsegment", "n__n_name").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS top FROM supplier WHERE s_acctbal > 100 GROUP BY 1")
def source_duckdb(spark, sf):
    import duckdb

    path = f"{_folder(spark)}/base.duckdb"
    with duckdb.connect(path) as base:
        base.execute(f"create table supplier as select * from read_parquet('{sf}/supplier.parquet')")
    e = _engine(spark, sf)
    e.catalog.register("d", "duckdb", path)
    return e.frame("SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS top FROM supplier WHERE s_acctbal > 100 GROUP BY s_nationkey", ["d"])[0]


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def source_jdbc_ranges(spark, sf):
    """A table of an embedded JDBC database, read in four ranges of its key."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size").toDF("P_PARTKEY", "P_BRAND", "P_SIZE")
    url = _derby(spark, parts, "PARTS", "P_PARTKEY bigint, P_BRAND varchar(32672), P_SIZE integer")
    e = _engine(spark, sf)
    e.catalog.register("j", "jdbc", url, driver=driver, partitionColumn="P_PARTKEY", numPartitions="4")
    return e.frame("SELECT P_BRAND AS p_brand, count(*) AS n, sum(P_SIZE) AS size FROM PARTS GROUP BY P_BRAND", ["j"])[0]


@query("SELECT role, count(*) AS n, max(turn) AS last FROM conversations WHERE turn >= 1 GROUP BY 1")
def source_documents(spark, sf):
    folder = _folder(spark)
    spark.read.parquet(f"{sf}/conversations.parquet").select("role", "turn").write.json(f"{folder}/talks.json")
    e = _engine(spark, sf)
    e.catalog.register("docs", "documents", folder)
    df, _ = e.frame({"collection": "talks", "pipeline": [{"$match": {"turn": {"$gte": 1}}}, {"$group": {"_id": "$role", "n": {"$sum": 1}, "last": {"$max": "$turn"}}}]})
    return df.withColumnRenamed("_id", "role")


@query("SELECT k.kind, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) k(kind)")
def source_formats_and_sinks(spark, sf):
    """Each format written by the sink and read back through the catalog."""
    folder, e, out = _folder(spark), _engine(spark, sf), None
    for kind in catalogs.FILES:
        rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
        catalogs.write(rows.coalesce(1).toDF("n_nationkey", "n_name"), f"{folder}/{kind}/nation.{kind}", kind) if kind != "csv" else rows.coalesce(1).write.option("header", "true").csv(f"{folder}/csv/nation.csv")
        e.catalog.register(kind, kind, f"{folder}/{kind}")
        part = e.frame("SELECT n_nationkey, n_name FROM nation", [kind])[0].select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def sink_appends_partitions(spark, sf):
    path = _folder(spark) + "/orders.parquet"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for _ in range(2):
        catalogs.write(orders, path, "parquet", partition_by=("o_orderstatus",))
    half = spark.read.parquet(path).groupBy("o_orderstatus").agg((F.count("*") / 2).cast("bigint").alias("n"))
    return half.unionAll(half)


@query("""SELECT * FROM (VALUES ('postgresql://u:p@h/db?a=b', 'jdbc', 'jdbc:postgresql://h:5432/db?a=b'), ('mysql://h:9/db', 'jdbc', 'jdbc:mysql://h:9/db'), ('mysql://h/db', 'jdbc', 'jdbc:mysql://h:3306/db'),
  ('sqlite:////a/b.db', 'sqlite', '/a/b.db'), ('duckdb:///a.db', 'duckdb', '/a.db'), ('mongodb://h/x', 'mongodb', 'mongodb://h/x'), ('parquet:///data', 'parquet', '/data')) v(uri, kind, location)""")
def source_uris(spark, sf):
    return _state(spark, *((u, *catalogs.parse_uri(u)) for u in ("postgresql://u:p@h/db?a=b", "mysql://h:9/db", "mysql://h/db", "sqlite:////a/b.db", "duckdb:///a.db", "mongodb://h/x", "parquet:///data")), schema="uri string, kind string, location string")


@query("SELECT least(50, count(c_name)) AS n, true AS inside FROM customer")
def source_column_sample(spark, sf):
    e = _engine(spark, sf)
    got = e.catalog.sample_column("files", "customer", "c_name", 50)
    known = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_name").distinct().where(F.col("c_name").isin(got)).collect()}
    return _state(spark, (len(got), set(got) <= known), schema="n bigint, inside boolean")


@query("SELECT table_name AS t, column_name AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' ELSE data_type END AS kind FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'supplier')")
def schema_introspection(spark, sf):
    found = _engine(spark, sf).schema("files")
    return _state(spark, *((t, c["name"], c["dtype"]) for t in ("customer", "nation", "supplier") for c in found[t]["columns"]), schema="t string, c string, kind string")


@query("SELECT table_name AS t, column_name AS c FROM duckdb_columns() WHERE data_type = 'VARCHAR' AND table_name IN ('documents', 'pages', 'benchmark', 'conversations', 'customer') AND column_name IN ('text', 'body', 'comment', 'description')")
def schema_free_text(spark, sf):
    found = _engine(spark, sf).schema("files")
    return _state(spark, *((t, c["name"]) for t in ("documents", "pages", "benchmark", "conversations", "customer") for c in found[t]["columns"] if c["is_unstructured"]), schema="t string, c string")


@query("SELECT 'customer' AS t, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def schema_row_counts(spark, sf):
    found = _engine(spark, sf).schema()["files"]
    return _state(spark, *((t, found[t]["row_count"]) for t in ("customer", "nation", "orders")), schema="t string, rows bigint")


@query("SELECT * FROM (VALUES ('first', ''), ('same', ''), ('changed', 'nation,other')) v(step, tables)")
def schema_cache_and_diff(spark, sf):
    """A cached schema is compared with what the source has now."""
    e = _engine(spark, sf)
    e.catalog.register("x", "frames", frames={"nation": e.catalog.table("files", "nation"), "region": e.catalog.table("files", "region")})
    scanner = SchemaScanner(e.catalog, SchemaCache(f"{_folder(spark)}/cache", 3600))
    scanner.scan("x")
    out = [("first", ",".join(scanner.diff("x")))]
    scanner.scan("x")
    out.append(("same", ",".join(scanner.diff("x"))))
    e.catalog.sources["x"].frames |= {"nation": spark.range(1), "other": spark.range(1)}
    return _state(spark, *out, ("changed", ",".join(sorted(scanner.diff("x")))), schema="step string, tables string")


@query("SELECT * FROM (VALUES ('files', 'parquet', 'connected'), ('gone', 'parquet', 'error')) v(alias, kind, status)")
def source_health(spark, sf):
    e = _engine(spark, sf)
    e.catalog.register("gone", "parquet", "/no/such/folder")
    return _state(spark, *((c["alias"], c["type"], c["status"].partition(":")[0]) for c in e.connections()), schema="alias string, kind string, status string")


# -- plans --------------------------------------------------------------------


@query("SELECT 7::BIGINT AS row_count, true AS truncated UNION ALL SELECT count(*), false FROM nation")
def plan_row_cap(spark, sf):
    e = _engine(spark, sf)
    a, b = e.query("SELECT * FROM orders", ["files"], row_limit=7), e.query("SELECT * FROM nation", ["files"], row_limit=25)
    return _state(spark, (a.row_count, a.truncated), (b.row_count, b.truncated), schema="row_count bigint, truncated boolean")


@query("SELECT count(DISTINCT o_custkey) AS row_count, false AS truncated FROM orders")
def plan_aggregate_keeps_groups(spark, sf):
    r = _engine(spark, sf).query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", ["files"], row_limit=5)
    return _state(spark, (r.row_count, r.truncated), schema="row_count bigint, truncated boolean")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def plan_group_limit_is_lifted(spark, sf):
    return _engine(spark, sf).frame("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment LIMIT 2", ["files"])[0]


@query("SELECT least(2, count(DISTINCT c_mktsegment)) AS n FROM customer")
def plan_group_limit_is_honoured(spark, sf):
    return _engine(spark, sf).frame("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment LIMIT 2", ["files"], honor_limit=True)[0].agg(F.count("*").alias("n"))


@query("SELECT 'single_database' AS strategy, 'files' AS databases, '' AS merge_on UNION ALL SELECT 'federated', 'files', 'o.o_custkey=c.c_custkey'")
def plan_provenance(spark, sf):
    e = _engine(spark, sf)
    spec = {"sub_queries": [_sub("o", "SELECT o_custkey FROM orders"), _sub("c", "SELECT c_custkey FROM customer")], "join_on": [["o.o_custkey", "c.c_custkey"]]}
    plans = [e.plan("SELECT * FROM nation", ["files"]), e.plan(spec)]
    return _state(spark, *((p["strategy"], ",".join(p["databases"]), ",".join("=".join(x) for x in p["merge_on"])) for p in plans), schema="strategy string, databases string, merge_on string")


@query("SELECT n_name, r_name AS r__r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def plan_spec_as_text(spark, sf):
    """A spec as JSON text whose sub-queries are JSON text again."""
    subs = [_sub("n", "SELECT n_name, n_regionkey FROM nation"), _sub("r", "SELECT r_regionkey, r_name FROM region")]
    return _engine(spark, sf).frame(json.dumps({"sub_queries": json.dumps(subs), "join_on": [["n.n_regionkey", "r.r_regionkey"]]}))[0].select("n_name", "r__r_name")


@query("SELECT c__c_mktsegment, sum_o_totalprice FROM (SELECT c_mktsegment AS c__c_mktsegment, round(sum(o_totalprice), 4) AS sum_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ORDER BY 2 DESC LIMIT 2")
def plan_spec_with_transforms(spark, sf):
    spec = {"sub_queries": [_sub("o", "SELECT o_custkey, o_totalprice FROM orders"), _sub("c", "SELECT c_custkey, c_mktsegment FROM customer")], "join_on": [["o.o_custkey", "c.c_custkey"]], "transform": [{"op": "group_sum", "group_by": "c__c_mktsegment", "value": "o_totalprice"}, {"op": "top_n_with_ties", "column": "sum_o_totalprice", "n": 2}]}
    return _engine(spark, sf).frame(spec)[0].withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 4)).select("c__c_mktsegment", "sum_o_totalprice")


@query("SELECT unnest(['customer', 'nation', 'orders']) AS t")
def plan_tables(spark, sf):
    df = _engine(spark, sf).frame("WITH x AS (SELECT * FROM customer) SELECT n_name FROM x JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)", ["files"])[0]
    return _state(spark, *((n,) for n in sorted(set(guard.tables(df)) - {"x"})), schema="t string")


@query("SELECT * FROM (VALUES ('again', 'refused'), ('dear', 'cost_overrun'), ('drop', 'safety_violation'), ('first', 'ok'), ('gone', 'planning_error'), ('hidden', 'safety_violation'), ('no dot', 'planning_error'), ('no key', 'planning_error'), ('nope', 'execution_error'), ('path', 'safety_violation'), ('reset', 'ok')) v(step, verdict)")
def plan_errors(spark, sf):
    """Repeats, the cost gate and each kind of error."""
    e = _engine(spark, sf, hidden_tables=("labels",))
    two = [_sub("a", "SELECT 1 AS x"), _sub("b", "SELECT 1 AS x")]
    verdict = lambda r: "ok" if not r.error else r.error_type or "refused"
    steps = [
        ("first", e.query("SELECT count(*) AS n FROM nation", ["files"], session_id="s")),
        ("again", e.query("select COUNT(*) AS n  FROM nation", ["files"], session_id="s")),
        ("drop", e.query("DROP TABLE nation", ["files"])),
        ("gone", e.query("SELECT 1", ["elsewhere"])),
        ("nope", e.query("SELECT nope FROM nation", ["files"])),
        ("hidden", e.query("SELECT * FROM labels", ["files"])),
        ("path", e.query(f"SELECT * FROM parquet.`{sf}/labels.parquet`", ["files"])),
        ("no dot", e.query({"sub_queries": two, "join_on": [["a.x", "x"]]})),
        ("no key", e.query({"sub_queries": two, "join_on": [["a.x", "c.x"]]})),
    ]
    e.reset_session("s")
    steps.append(("reset", e.query("SELECT count(*) AS n FROM nation", ["files"], session_id="s")))
    e.config.max_cost_bytes = 0
    steps.append(("dear", e.query("SELECT * FROM nation", ["files"])))
    return _state(spark, *((k, verdict(r)) for k, r in steps), schema="step string, verdict string")


# -- joins --------------------------------------------------------------------


@query("SELECT l.l_orderkey, l.l_linenumber, s.s_nationkey AS s__s_nationkey, p.p_brand AS p__p_brand FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey")
def join_star(spark, sf):
    spec = {"sub_queries": [_sub("l", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem"), _sub("s", "SELECT s_suppkey, s_nationkey FROM supplier"), _sub("p", "SELECT p_partkey, p_brand FROM part")], "join_on": [["l.l_suppkey", "s.s_suppkey"], ["l.l_partkey", "p.p_partkey"]]}
    return _engine(spark, sf).frame(spec)[0].select("l_orderkey", "l_linenumber", "s__s_nationkey", "p__p_brand")


@query("SELECT c.c_custkey, b.s_suppkey AS s__s_suppkey FROM customer c JOIN supplier a ON c.c_nationkey = a.s_nationkey JOIN supplier b ON c.c_custkey = b.s_suppkey")
def join_chain_of_two_pairs(spark, sf):
    """Two pairs of the same keys as joins one after the other; the second gives the right side's columns."""
    spec = {"sub_queries": [_sub("c", "SELECT c_custkey, c_nationkey FROM customer"), _sub("s", "SELECT s_suppkey, s_nationkey FROM supplier")], "join_on": [["c.c_nationkey", "s.s_nationkey"], ["c.c_custkey", "s.s_suppkey"]]}
    return _engine(spark, sf).frame(spec, pair_semantics="chain")[0].select("c_custkey", "s__s_suppkey")


@query("SELECT c.c_custkey, s.s_suppkey AS s__s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey")
def join_two_pairs_at_once(spark, sf):
    spec = {"sub_queries": [_sub("c", "SELECT c_custkey, c_nationkey FROM customer"), _sub("s", "SELECT s_suppkey, s_nationkey FROM supplier")], "join_on": [["c.c_nationkey", "s.s_nationkey"], ["c.c_custkey", "s.s_suppkey"]]}
    return _engine(spark, sf).frame(spec)[0].select("c_custkey", "s__s_suppkey")


@query("SELECT c_custkey, n_name AS n__n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_by_rule(spark, sf):
    """No join in the spec: the confirmed rule between the two tables gives it."""
    e = _engine(spark, sf)
    e.catalog.register("geo", "parquet", sf)
    e.registry.save(JoinRule("geo", "nation", "n_nationkey", "files", "customer", "c_nationkey", "identity", 0.9, True))
    df, plan = e.frame({"sub_queries": [_sub("c", "SELECT c_custkey, c_nationkey FROM customer"), _sub("n", "SELECT n_nationkey, n_name FROM nation", "geo")]})
    return df.select("c_custkey", "n__n_name")


@query("SELECT 'join' AS mode, 0::BIGINT AS n UNION ALL SELECT 'passthrough', count(*) FROM nation")
def join_empty_right(spark, sf):
    e, out = _engine(spark, sf), []
    spec = {"sub_queries": [_sub("n", "SELECT n_nationkey, n_name FROM nation"), _sub("r", "SELECT r_regionkey FROM region WHERE r_regionkey < 0")], "join_on": [["n.n_nationkey", "r.r_regionkey"]]}
    for mode in ("join", "passthrough"):
        out.append((mode, e.frame(spec, empty_right=mode)[0].count()))
    return _state(spark, *out, schema="mode string, n bigint")


@query("SELECT count(*) AS n, true AS warned FROM nation")
def join_unknown(spark, sf):
    r = _engine(spark, sf).query({"sub_queries": [_sub("n", "SELECT n_name FROM nation"), _sub("r", "SELECT r_name FROM region")]})
    return _state(spark, (r.row_count, any("no join" in w for w in r.warnings)), schema="n bigint, warned boolean")


@query("SELECT count(*) AS n, 'a.k=b.props__ref' AS pair FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_detected_in_json(spark, sf):
    """Keys of unlike forms, one of them a field of an object in text, found in the two results."""
    e = _engine(spark, sf)
    spec = {"sub_queries": [_sub("a", "SELECT concat('REG-', lpad(n_regionkey, 7, '0')) AS k, n_name FROM nation"), _sub("b", "SELECT concat('{\"ref\": \"reg', lpad(r_regionkey, 7, '0'), '\", \"n\": ', r_regionkey * 3 + 1, '}') AS props FROM region")]}
    r = e.query(spec, detect=True)
    return _state(spark, (r.row_count, ",".join("=".join(x) for x in r.provenance["merge_on"])), schema="n bigint, pair string")


@query("SELECT * FROM (VALUES (1, 'nation', 'n_regionkey', 'region', 'r_regionkey', 0.65::DOUBLE, false), (2, 'nation', 'n_regionkey', 'region', 'r_regionkey', 0.67, false), (3, 'nation', 'n_regionkey', 'region', 'r_regionkey', 0.67, true)) v(step, table_a, column_a, table_b, column_b, confidence, confirmed)")
def join_learned_from_specs(spark, sf):
    """A spec's join becomes a rule, the next run reinforces it, and it can be confirmed."""
    e, out = _engine(spark, sf), []
    spec = {"sub_queries": [_sub("n", "SELECT n_regionkey AS r, n_name FROM nation"), _sub("r", "SELECT r_regionkey, r_name FROM region")], "join_on": [["n.r", "r.r_regionkey"]]}
    for step in (1, 2, 3):
        if step < 3:
            e.query(spec)
        else:
            e.joins(confirm=e.joins()[0]["join_id"])
        r = e.joins()[0]
        out.append((step, r["table_a"], r["column_a"], r["table_b"], r["column_b"], r["confidence"], r["confirmed"]))
    return _state(spark, *out, schema="step int, table_a string, column_a string, table_b string, column_b string, confidence double, confirmed boolean")


@query("""SELECT * FROM (SELECT 'c_custkey' AS column_a, (0.35 * 0.85 + 0.65 * count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(DISTINCT c_custkey))::DOUBLE AS forward,
  (SELECT count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(DISTINCT o_custkey) FROM orders)::DOUBLE AS backward FROM customer)""")
def join_rules_verified(spark, sf):
    """A rule measured again, by all values in both directions."""
    e = _engine(spark, sf, value_sample_size=None)
    e.registry.save(JoinRule("files", "customer", "c_custkey", "files", "orders", "o_custkey", "identity", 0.1))
    finder = discovery.JoinDiscovery(e.catalog, sample=None)
    (rule, score, _), = finder.verify(e.registry.get_all())
    ends = ((rule.db_a, rule.table_a, rule.column_a), (rule.db_b, rule.table_b, rule.column_b))
    forward, backward = finder._scored([ends])[0][1], finder._scored([ends[::-1]])[0][1]
    similarity = discovery.name_similarity(rule.column_a, rule.column_b)
    return _state(spark, (rule.column_a, 0.35 * similarity + 0.65 * forward, (score - round(0.35 * similarity, 4)) / 0.65), schema="column_a string, forward double, backward double").withColumn("backward", F.round("backward", 3))


@query("SELECT n_name AS raw, 'lowercase' AS transform, lower(n_name) AS by_sql FROM nation UNION ALL SELECT n_name, 'strip_prefix_3', substr(n_name, 4) FROM nation UNION ALL SELECT n_name, 'remove_separators', regexp_replace(n_name, '[-_\\s]', '', 'g') FROM nation")
def key_transform_as_sql(spark, sf):
    """The SQL text of a key's transform, run by a source."""
    sql_functions.register(spark)
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    out = None
    for name in ("lowercase", "strip_prefix_3", "remove_separators"):
        part = nation.select(F.col("n_name").alias("raw"), F.lit(name).alias("transform"), F.expr(keys.transform_sql(name, "n_name")).alias("by_sql"))
        out = part if out is None else out.unionAll(part)
    return out


# -- checks, log, statistics --------------------------------------------------


@query("SELECT * FROM (VALUES ('fine', true), ('none', false)) v(step, plausible)")
def verify_rows(spark, sf):
    e = _engine(spark, sf)
    fine, none = e.query("SELECT count(*) AS n FROM orders", ["files"]), e.query("SELECT * FROM orders WHERE o_orderkey < 0", ["files"])
    e.schema()
    return _state(spark, ("fine", fine.plausibility.score == 1.0), ("none", plausibility([], "SELECT * FROM orders", {"files": e.scanner.cache.load("files")}, 1000).score == 1.0 and none.row_count > 0), schema="step string, plausible boolean")


@query("SELECT 'SELECT count(*) AS n FROM orders' AS query, 1::BIGINT AS row_count, 'files' AS databases UNION ALL SELECT 'SELECT * FROM nation', count(*), 'files' FROM nation")
def audit_log(spark, sf):
    e = _engine(spark, sf)
    for q in ("SELECT count(*) AS n FROM orders", "SELECT * FROM nation"):
        e.query(q, ["files"], session_id="s")
    return _state(spark, *((a["query"], a["row_count"], a["databases"] if isinstance(a["databases"], str) else ",".join(a["databases"])) for a in e.audit(session_id="s")), schema="query string, row_count bigint, databases string")


@query("SELECT round(stddev_pop(o_totalprice), 4) AS spread, round(median(o_totalprice), 4) AS middle FROM orders")
def math_expression(spark, sf):
    row, = _engine(spark, sf).math_compute("SELECT o_totalprice FROM orders", databases=["files"], expression={"spread": "round(stddev_pop(o_totalprice), 4)", "middle": "round(median(o_totalprice), 4)"})
    return _state(spark, (row["spread"], row["middle"]), schema="spread double, middle double")


@query("SELECT 'files.nation(' || string_agg(column_name || ' ' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'string' END, ', ' ORDER BY column_index) || ') -- ' || (SELECT count(*) FROM nation) || ' rows' AS line FROM duckdb_columns() WHERE table_name = 'nation'")
def context_text(spark, sf):
    e = _engine(spark, sf)
    return _state(spark, *((x,) for x in e.context("files", samples=0).splitlines() if x.startswith("files.nation(")), schema="line string")


# -- functions of the user's own ----------------------------------------------


@query("SELECT p_partkey, p_size * p_size AS squared FROM part")
def user_function(spark, sf):
    def squared(x: pd.Series) -> pd.Series:
        return x.astype("int64") ** 2

    user.scalar(spark, "squared", squared, "int")
    return _engine(spark, sf).frame("SELECT p_partkey, squared(p_size) AS squared FROM part", ["files"])[0]


@query("SELECT c_mktsegment, max(c_custkey) - min(c_custkey) AS reach FROM customer GROUP BY 1")
def user_aggregate(spark, sf):
    def reach(x: pd.Series) -> int:
        return int(x.max() - x.min())

    user.aggregate(spark, "reach", reach, "bigint")
    return _engine(spark, sf).frame("SELECT c_mktsegment, reach(c_custkey) AS reach FROM customer GROUP BY c_mktsegment", ["files"])[0]


@query("SELECT r_name, i::INTEGER AS i, substr(r_name, i::INTEGER, 1) AS letter FROM region, LATERAL (SELECT unnest(range(1, length(r_name) + 1)) AS i) t")
def user_table_function(spark, sf):
    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text, 1):
                yield i, c

    user.table(spark, "letters", Letters, "i int, letter string")
    return _engine(spark, sf).frame("SELECT r_name, t.i, t.letter FROM region, LATERAL letters(r_name) t", ["files"])[0]
