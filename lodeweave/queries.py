"""Registered queries, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import keys, sql
from .operators import docpipe, ranges, stats
from .operators.merge import Pair, merge
from .operators.transforms import apply
from .plans import discovery, guard
from .sources.catalog import SourceCatalog
from .sources.profile import profile_rows
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _views(spark: SparkSession, sf: str) -> None:
    for name in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        _t(spark, sf, name).createOrReplaceTempView(name)


def _spec_frames(spark: SparkSession, sf: str, subs: dict[str, str]) -> dict[str, DataFrame]:
    """Sub-queries of a spec, each over the tables as a source of its own."""
    catalog = SourceCatalog(spark)
    catalog.register("tables", "parquet", sf)
    for text in subs.values():
        guard.check(spark, text)
    _views(spark, sf)
    return {k: spark.sql(q) for k, q in subs.items()}


# -- federated joins ----------------------------------------------------------


@query("""
WITH g AS (SELECT c_mktsegment AS c__c_mktsegment, round(sum(o_totalprice), 4) AS sum_o_totalprice
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY sum_o_totalprice DESC) AS k FROM g)
SELECT c__c_mktsegment, sum_o_totalprice FROM r WHERE k <= 3""")
def federated_join_group_sum_topn(spark, sf):
    frames = {"o": _t(spark, sf, "orders").select("o_custkey", "o_totalprice"), "c": _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")}
    joined = merge(frames, [Pair.parse("o.o_custkey", "c.c_custkey")]).select("c__c_mktsegment", "o_totalprice")
    return apply(joined, [{"op": "group_sum", "group_by": "c__c_mktsegment", "value": "o_totalprice"}, {"op": "top_n_with_ties", "column": "sum_o_totalprice", "n": 3}]).drop("o_totalprice")


@query("""
SELECT a.l_orderkey AS ok, a.l_linenumber AS ln, a.q AS q, b.l_orderkey AS b__ok, b.l_linenumber AS b__ln, b.p AS b__p
FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2) a
JOIN (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS p FROM lineitem WHERE l_tax > 0.03 GROUP BY 1, 2) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def federated_join_composite_key(spark, sf):
    frames = _spec_frames(spark, sf, {
        "a": "SELECT l_orderkey AS ok, l_linenumber AS ln, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2",
        "b": "SELECT l_orderkey AS ok, l_linenumber AS ln, max(l_extendedprice) AS p FROM lineitem WHERE l_tax > 0.03 GROUP BY 1, 2",
    })
    return merge(frames, [Pair.parse("a.ok", "b.ok"), Pair.parse("a.ln", "b.ln")])


@query("""
SELECT c_mktsegment AS c__c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def federated_join_three_way(spark, sf):
    frames = {"l": _t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), "o": _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "c": _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")}
    joined = merge(frames, [Pair.parse("l.l_orderkey", "o.o_orderkey"), Pair.parse("o.o_custkey", "c.c_custkey")])
    return joined.groupBy("c__c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("""
SELECT a.l_orderkey AS ok, b.o_custkey AS b__o_custkey, b.o_orderkey AS b__o_orderkey
FROM (SELECT DISTINCT l_orderkey FROM lineitem) a JOIN orders b ON a.l_orderkey = b.o_custkey""")
def federated_join_chain_pairs(spark, sf):
    frames = _spec_frames(spark, sf, {"a": "SELECT DISTINCT l_orderkey AS ok FROM lineitem", "b": "SELECT o_orderkey, o_custkey FROM orders"})
    return merge(frames, [Pair.parse("a.ok", "b.o_custkey")], pair_semantics="chain")


def _key_query(name: str, left: str, right: str, transform: str, oracle: str) -> None:
    def run(spark, sf):
        frames = _spec_frames(spark, sf, {"a": left, "b": right})
        return merge(frames, [Pair("a", "x", "b", "y", transform)])

    query(oracle, f"join_{transform}")(run)


_key_query("join_extract_digits", "SELECT n_name AS x, n_regionkey FROM nation", "SELECT n_nationkey AS y, n_name AS n FROM nation", "extract_digits",
           "SELECT a.n_name AS x, a.n_regionkey, b.n_nationkey AS b__y, b.n_name AS b__n FROM nation a JOIN nation b ON regexp_replace(a.n_name, '[^0-9]', '', 'g') = b.n_nationkey::VARCHAR")
_key_query("join_strip_prefix_3", "SELECT source AS x, count(*) AS n FROM documents GROUP BY source", "SELECT n_nationkey AS y, n_name FROM nation", "strip_prefix_3",
           "SELECT a.source AS x, a.n, b.n_nationkey AS b__y, b.n_name AS b__n_name FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a JOIN nation b ON substr(a.source, 4) = b.n_nationkey::VARCHAR")
_key_query("join_strip_prefix_4", "SELECT concat('abcd', n_name) AS x FROM nation", "SELECT n_name AS y FROM nation", "strip_prefix_4",
           "SELECT concat('abcd', n_name) AS x, n_name AS b__y FROM nation")
_key_query("join_strip_prefix_5", "SELECT concat('abcde', n_name) AS x FROM nation", "SELECT n_name AS y FROM nation", "strip_prefix_5",
           "SELECT concat('abcde', n_name) AS x, n_name AS b__y FROM nation")
_key_query("join_lowercase", "SELECT upper(r_name) AS x, r_regionkey FROM region", "SELECT lower(r_name) AS y FROM region", "lowercase",
           "SELECT upper(a.r_name) AS x, a.r_regionkey, lower(b.r_name) AS b__y FROM region a JOIN region b ON lower(a.r_name) = lower(b.r_name)")
_key_query("join_zfill_5", "SELECT c_custkey AS x, c_nationkey FROM customer", "SELECT right(c_name, 5) AS y, c_mktsegment FROM customer", "zfill_5",
           "SELECT a.c_custkey AS x, a.c_nationkey, right(b.c_name, 5) AS b__y, b.c_mktsegment AS b__c_mktsegment FROM customer a JOIN customer b ON CASE WHEN length(a.c_custkey::VARCHAR) < 5 THEN lpad(a.c_custkey::VARCHAR, 5, '0') ELSE a.c_custkey::VARCHAR END = right(b.c_name, 5)")
_key_query("join_zfill_7", "SELECT c_custkey AS x FROM customer", "SELECT right(c_name, 7) AS y, c_acctbal FROM customer", "zfill_7",
           "SELECT a.c_custkey AS x, right(b.c_name, 7) AS b__y, b.c_acctbal AS b__c_acctbal FROM customer a JOIN customer b ON CASE WHEN length(a.c_custkey::VARCHAR) < 7 THEN lpad(a.c_custkey::VARCHAR, 7, '0') ELSE a.c_custkey::VARCHAR END = right(b.c_name, 7)")
_key_query("join_remove_separators", "SELECT o_orderpriority AS x, count(*) AS n FROM orders GROUP BY 1", "SELECT DISTINCT replace(o_orderpriority, '-', '') AS y FROM orders", "remove_separators",
           "SELECT a.x, a.n, replace(a.x, '-', '') AS b__y FROM (SELECT o_orderpriority AS x, count(*) AS n FROM orders GROUP BY 1) a WHERE a.x NOT LIKE '% %' AND a.x NOT LIKE '%\\_%' ESCAPE '\\'")
_key_query("join_identity", "SELECT concat('  ', r_name, ' ') AS x, r_regionkey FROM region", "SELECT r_name AS y FROM region", "identity",
           "SELECT concat('  ', r_name, ' ') AS x, r_regionkey, r_name AS b__y FROM region")


@query("""SELECT a.n_nationkey, b.k AS b__k FROM nation a JOIN (SELECT n_nationkey::VARCHAR AS k FROM nation) b ON a.n_nationkey::VARCHAR = b.k""")
def join_text_of_number(spark, sf):
    n = _t(spark, sf, "nation")
    return merge({"a": n.select("n_nationkey"), "b": n.select(F.col("n_nationkey").cast("string").alias("k"))}, [Pair.parse("a.n_nationkey", "b.k")])


# -- transforms ---------------------------------------------------------------


def _step_query(name: str, table: str, columns: list[str], steps: list[dict], oracle: str, output: list[str] | None = None) -> None:
    def run(spark, sf):
        df = apply(_t(spark, sf, table).selectExpr(*columns), steps)
        return df.select(*output) if output else df

    query(oracle, name)(run)


_step_query("extract_number_patterns", "part", ["p_partkey", "concat('has ', p_size, ',000 stars and ', p_size, ' forks') AS t"],
            [{"op": "extract_number", "column": "t", "metric": "stars"}, {"op": "extract_number", "column": "t", "patterns": [r"(\d+) gone", r"([\d,]+)\s+forks"], "output": "f"}],
            "SELECT p_partkey, concat('has ', p_size, ',000 stars and ', p_size, ' forks') AS t, p_size::BIGINT * 1000 AS stars, p_size::BIGINT AS f FROM part")
_step_query("cast_number", "part", ["p_partkey", "concat(' 1,', p_size + 100, ' ') AS t"], [{"op": "cast_number", "column": "t", "output": "n"}],
            "SELECT p_partkey, concat(' 1,', p_size + 100, ' ') AS t, 1000 + p_size::BIGINT + 100 AS n FROM part")
_step_query("project_name_from_text", "part", ["p_partkey", "case when p_size > 20 then concat('Project acme/lib', p_partkey, ' on GitHub') else 'none' end AS t"], [{"op": "project_name_from_text", "column": "t"}],
            "SELECT p_partkey, CASE WHEN p_size > 20 THEN concat('Project acme/lib', p_partkey, ' on GitHub') ELSE 'none' END AS t, CASE WHEN p_size > 20 THEN concat('acme/lib', p_partkey) END AS project_name FROM part")
_step_query("round_down_bucket", "part", ["p_partkey", "p_size"], [{"op": "round_down", "column": "p_size", "to": 10, "output": "bucket"}],
            "SELECT p_partkey, p_size, (floor(p_size / 10) * 10)::BIGINT AS bucket FROM part")
_step_query("regex_extract", "part", ["p_partkey", "p_brand"], [{"op": "regex_extract", "column": "p_brand", "pattern": r"([A-Za-z]+)#(\d)(\d+)?", "group": 2, "output": "d"}, {"op": "regex_extract", "column": "p_brand", "pattern": r"#\d+", "output": "w"}],
            "SELECT p_partkey, p_brand, nullif(regexp_extract(p_brand, '([A-Za-z]+)#([0-9])([0-9]+)?', 2), '') AS d, nullif(regexp_extract(p_brand, '#[0-9]+', 0), '') AS w FROM part")
_step_query("string_map", "orders", ["o_orderkey", "o_orderpriority"], [{"op": "string_map", "column": "o_orderpriority", "pattern": r"^(\d)-(M)?", "replacement": r"\1 ", "output": "p"}],
            "SELECT o_orderkey, o_orderpriority, trim(regexp_replace(o_orderpriority, '(?i)^([0-9])-(M)?', '\\1 ', 'g')) AS p FROM orders")
_step_query("string_filter", "part", ["p_partkey", "p_type"], [{"op": "string_filter", "column": "p_type", "pattern": "e", "ignore_case": True}, {"op": "string_filter", "column": "p_type", "pattern": "^Z", "mode": "drop"}],
            "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)e') AND NOT regexp_matches(p_type, '^Z')")
_step_query("text_extract_list", "part", ["p_partkey", "case when p_size % 3 = 0 then concat('Serves Pizza, Pasta, Size', p_size, '. In Reno, Nevada') when p_size % 3 = 1 then 'none here' else 'Alpha, Beta. Cee, Dee, Eff' end AS t"], [{"op": "text_extract_list", "column": "t", "output": "l"}],
            "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('Serves Pizza, Pasta, Size', p_size, '. In Reno, Nevada') WHEN p_size % 3 = 1 THEN 'none here' ELSE 'Alpha, Beta. Cee, Dee, Eff' END AS t, CASE WHEN p_size % 3 = 0 THEN concat('Serves Pizza, Pasta, Size', p_size) WHEN p_size % 3 = 2 THEN 'Cee, Dee, Eff' END AS l FROM part")
_step_query("string_after_last", "pages", ["page_id", "url"], [{"op": "string_after_last", "column": "url", "separator": "/", "output": "leaf"}],
            "SELECT page_id, url, CASE WHEN contains(url, '/') THEN trim(string_split(url, '/')[-1]) END AS leaf FROM pages")
_step_query("string_after_any_last", "orders", ["o_orderkey", "o_orderpriority"], [{"op": "string_after_any_last", "column": "o_orderpriority", "separators": ["-", "I"], "output": "tail"}],
            "SELECT o_orderkey, o_orderpriority, CASE WHEN contains(o_orderpriority, '-') OR contains(o_orderpriority, 'I') THEN regexp_extract(o_orderpriority, '.*[-I](.*)$', 1) END AS tail FROM orders")
_step_query("string_before_first", "orders", ["o_orderkey", "o_orderpriority"], [{"op": "string_before_first", "column": "o_orderpriority", "separator": "-", "output": "head"}],
            "SELECT o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 1) AS head FROM orders")
_step_query("string_strip_prefix_digits", "orders", ["o_orderkey", "o_orderpriority"], [{"op": "string_strip_prefix", "column": "o_orderpriority", "output": "p"}],
            "SELECT o_orderkey, o_orderpriority, trim(regexp_replace(o_orderpriority, '^[0-9]+[-.\\s]+', '')) AS p FROM orders")
_step_query("string_strip_prefix_dash", "part", ["p_partkey", "concat(p_brand, ' - ', p_type, ' - x') AS t"], [{"op": "string_strip_prefix", "column": "t", "preset": "before_dash", "output": "p"}],
            "SELECT p_partkey, concat(p_brand, ' - ', p_type, ' - x') AS t, concat(p_type, ' - x') AS p FROM part")
_step_query("string_drop_between", "part", ["p_partkey", "concat(p_name, ' (', p_brand, ') end (', p_type, ')') AS t"], [{"op": "string_drop_between", "column": "t", "output": "u"}],
            "SELECT p_partkey, concat(p_name, ' (', p_brand, ') end (', p_type, ')') AS t, trim(regexp_replace(concat(p_name, ' (', p_brand, ') end (', p_type, ')'), '\\([^)]*\\)', '', 'g')) AS u FROM part")
_step_query("string_explode", "part", ["p_partkey", "concat(p_brand, ',  ', p_type, ', , x') AS t"], [{"op": "string_explode", "column": "t", "output": "piece"}],
            "SELECT p_partkey, trim(p) AS piece FROM (SELECT p_partkey, unnest(string_split(concat(p_brand, ',  ', p_type, ', , x'), ', ')) AS p FROM part) WHERE trim(p) <> ''")
_step_query("json_array_extract", "events", ["event_id", "props"], [{"op": "json_array_extract", "column": "props", "field": "k", "output": "ks"}, {"op": "json_explode", "column": "ks", "output": "k"}],
            "SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events")
_step_query("json_explode", "part", ["p_partkey", "case when p_size % 3 = 0 then array(p_size, 1) when p_size % 3 = 1 then array() end AS l"], [{"op": "json_explode", "column": "l", "output": "item"}],
            "SELECT p_partkey, unnest([p_size, 1]) AS item FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 2")
_step_query("parse_date_year", "orders", ["o_orderkey", "date_format(o_orderdate, 'MMMM d, yyyy') AS t", "date_format(o_orderdate, 'd MMM yyyy') AS u"], [{"op": "parse_date", "column": "t", "output": "day"}, {"op": "parse_date", "column": "u", "output": "y", "output_format": "%Y"}],
            "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS t, strftime(o_orderdate, '%-d %b %Y') AS u, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y') AS y FROM orders")
_step_query("filter_min_max", "orders", ["o_orderkey", "o_totalprice"], [{"op": "filter", "column": "o_totalprice", "min": 50_000, "max": 200_000}],
            "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 200000")
_step_query("filter_equals", "orders", ["o_orderkey", "o_orderstatus"], [{"op": "filter", "column": "o_orderstatus", "equals": "O"}],
            "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
_step_query("filter_text_passes", "part", ["p_partkey", "case when p_size > 25 then 'n/a' else cast(p_size as string) end AS v"], [{"op": "filter", "column": "v", "min": 10}],
            "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'n/a' ELSE p_size::VARCHAR END AS v FROM part WHERE p_size >= 10")
_step_query("top_n_with_ties_desc", "part", ["p_partkey", "p_size"], [{"op": "top_n_with_ties", "column": "p_size", "n": 7}],
            "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k FROM part) WHERE k <= 7")
_step_query("top_n_with_ties_asc", "part", ["p_partkey", "p_size"], [{"op": "top_n_with_ties", "column": "p_size", "n": 7, "direction": "asc"}],
            "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS k FROM part) WHERE k <= 7")
_step_query("group_count", "orders", ["o_orderpriority", "o_orderstatus"], [{"op": "group_count", "group_by": ["o_orderpriority", "o_orderstatus"], "output": "n"}],
            "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
_step_query("group_count_carry", "orders", ["o_orderpriority", "o_orderkey"], [{"op": "group_count", "group_by": "o_orderpriority", "order_by": "o_orderkey"}],
            "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey, count(*) AS count FROM orders GROUP BY 1")
_step_query("group_sum", "lineitem", ["l_returnflag", "l_quantity"], [{"op": "group_sum", "group_by": "l_returnflag", "value": "l_quantity", "output": "q"}],
            "SELECT l_returnflag, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1", ["l_returnflag", "q"])
_step_query("group_sum_text", "part", ["p_brand", "case when p_size % 2 = 0 then cast(p_size as string) when p_size % 5 = 0 then 'bad' end AS v"], [{"op": "group_sum", "group_by": "p_brand", "value": "v", "output": "s"}],
            "SELECT p_brand, round(sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END)::DOUBLE, 4) AS s FROM part GROUP BY 1", ["p_brand", "s"])
_step_query("group_avg", "orders", ["o_orderstatus", "cast(o_custkey as double) AS v"], [{"op": "group_avg", "group_by": "o_orderstatus", "value": "v", "output": "a"}],
            "SELECT o_orderstatus, count(*) AS a_n, round(avg(o_custkey::DOUBLE), 4) AS a FROM orders GROUP BY 1")
_step_query("group_avg_weighted", "lineitem", ["l_returnflag", "l_quantity", "l_linenumber"], [{"op": "group_avg", "group_by": "l_returnflag", "value": "l_quantity", "weight": "l_linenumber", "output": "a"}],
            "SELECT l_returnflag, count(*) AS a_n, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 4) AS a FROM lineitem GROUP BY 1")
_step_query("weighted_group_avg", "lineitem", ["l_linestatus", "l_quantity", "l_linenumber - 1 AS w"], [{"op": "weighted_group_avg", "group_by": "l_linestatus", "value": "l_quantity", "weight": "w", "output": "a"}],
            "SELECT l_linestatus, round(sum(l_quantity * greatest(l_linenumber - 1, 1)) / sum(greatest(l_linenumber - 1, 1)), 4) AS a FROM lineitem GROUP BY 1")
_step_query("having_group_avg", "orders", ["o_custkey", "cast(o_orderkey as double) AS v"], [{"op": "group_avg", "group_by": "o_custkey", "value": "v", "output": "a"}, {"op": "filter", "column": "a_n", "min": 5}],
            "SELECT o_custkey, count(*) AS a_n, round(avg(o_orderkey::DOUBLE), 4) AS a FROM orders GROUP BY 1 HAVING count(*) >= 5")


@query("SELECT c_custkey, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS v FROM customer)")
def sort_desc_nulls_first(spark, sf):
    df = _t(spark, sf, "customer").selectExpr("c_custkey", "case when c_nationkey = 3 then null else c_acctbal end AS v")
    ordered = apply(df, [{"op": "sort", "column": "v"}])
    return ordered.withColumn("place", F.row_number().over(W.orderBy(F.col("v").desc_nulls_first(), "c_custkey")).cast("long"))


@query("SELECT c_custkey, v, row_number() OVER (ORDER BY v NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS v FROM customer)")
def sort_asc_nulls_last(spark, sf):
    df = _t(spark, sf, "customer").selectExpr("c_custkey", "case when c_nationkey = 3 then null else c_acctbal end AS v")
    ordered = apply(df, [{"op": "sort", "by": "v", "direction": "asc"}])
    return ordered.withColumn("place", F.row_number().over(W.orderBy(F.col("v").asc_nulls_last(), "c_custkey")).cast("long"))


_MONTHS = "SELECT o_orderpriority AS g, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS s, count(*) AS v FROM orders GROUP BY 1, 2"
_EMA = f"""
WITH RECURSIVE m AS ({_MONTHS}), b AS (SELECT g, min(s) AS lo, max(s) AS hi FROM m GROUP BY 1),
f AS (SELECT b.g, t.s, coalesce(m.v, 0) AS v FROM b, LATERAL (SELECT unnest(generate_series(b.lo, b.hi)) AS s) t LEFT JOIN m ON m.g = b.g AND m.s = t.s),
e AS (SELECT f.g, f.s, f.v, f.v::DOUBLE AS ema FROM f JOIN b ON f.g = b.g AND f.s = b.lo
      UNION ALL SELECT f.g, f.s, f.v, 0.2 * f.v + 0.8 * e.ema FROM e JOIN f ON f.g = e.g AND f.s = e.s + 1)"""


def _months(spark, sf):
    o = _t(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("g"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("s")).agg(F.count("*").alias("v"))


@query(_EMA + " SELECT g, s, v::DOUBLE AS v, round(ema, 6) AS ema FROM e")
def ema_full(spark, sf):
    return apply(_months(spark, sf), [{"op": "compute_ema", "group_by": "g", "sort_by": "s", "value_col": "v", "summarize": False}])


@query(_EMA + " SELECT g, s, v::DOUBLE AS v, round(ema, 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ema DESC, s) AS k FROM e) WHERE k = 1")
def ema_summarize_gapfill(spark, sf):
    return stats.ema(_months(spark, sf), "g", "s", "v", alpha=0.2)


@query("""
WITH o AS (SELECT o_orderpriority AS r, c_mktsegment AS c, count(*)::DOUBLE AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT r.r, c.c, rm, cm, (SELECT sum(o) FROM o) AS t FROM (SELECT r, sum(o) AS rm FROM o GROUP BY 1) r, (SELECT c, sum(o) AS cm FROM o GROUP BY 1) c)
SELECT round(sum(power(coalesce(o.o, 0) - rm * cm / t, 2) / (rm * cm / t)), 6) AS chi_square, max(t)::BIGINT AS grand_total, count(DISTINCT g.r) AS rows_included, count(DISTINCT g.c) AS cols_included,
  0::BIGINT AS rows_excluded, 0::BIGINT AS cols_excluded, (count(DISTINCT g.r) - 1) * (count(DISTINCT g.c) - 1) AS dof FROM g LEFT JOIN o USING (r, c)""")
def chi_square(spark, sf):
    joined = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderpriority", "c_mktsegment")
    return stats.chi_square(joined, "o_orderpriority", "c_mktsegment").withColumn("chi_square", F.round("chi_square", 6))


@query("""
WITH a AS (SELECT p_brand AS r, p_size % 11 AS c, sum(p_size)::DOUBLE AS o FROM part GROUP BY 1, 2),
m AS (SELECT avg(o) AS x FROM (SELECT sum(o) AS o FROM a GROUP BY r)), n AS (SELECT avg(o) AS x FROM (SELECT sum(o) AS o FROM a GROUP BY c)),
b AS (SELECT (SELECT least(m.x, n.x) FROM m, n) AS x),
o AS (SELECT * FROM a WHERE r IN (SELECT r FROM a GROUP BY r HAVING sum(o) > (SELECT x FROM b)) AND c IN (SELECT c FROM a GROUP BY c HAVING sum(o) > (SELECT x FROM b))),
g AS (SELECT r.r, c.c, rm, cm, (SELECT sum(o) FROM o) AS t FROM (SELECT r, sum(o) AS rm FROM o GROUP BY 1) r, (SELECT c, sum(o) AS cm FROM o GROUP BY 1) c)
SELECT round(sum(power(coalesce(o.o, 0) - rm * cm / t, 2) / (rm * cm / t)), 6) AS chi_square, max(t)::BIGINT AS grand_total, count(DISTINCT g.r) AS rows_included, count(DISTINCT g.c) AS cols_included,
  (SELECT count(DISTINCT r) FROM a) - count(DISTINCT g.r) AS rows_excluded, (SELECT count(DISTINCT c) FROM a) - count(DISTINCT g.c) AS cols_excluded,
  (count(DISTINCT g.r) - 1) * (count(DISTINCT g.c) - 1) AS dof FROM g LEFT JOIN o USING (r, c)""")
def chi_square_min_marginal(spark, sf):
    """Rows and columns below the mean marginal are left out."""
    df = _t(spark, sf, "part").selectExpr("p_brand", "p_size % 11 AS c", "p_size")
    least = min(df.groupBy(k).agg(F.sum("p_size").alias("m")).agg(F.avg("m")).first()[0] for k in ("p_brand", "c"))
    return stats.chi_square(df, "p_brand", "c", "p_size", least).withColumn("chi_square", F.round("chi_square", 6))


@query("SELECT round(stddev_pop(l_quantity), 6) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, max(l_discount) AS top FROM lineitem")
def stddev_corr_expr(spark, sf):
    return stats.expression(_t(spark, sf, "lineitem"), spread="round(stddev_pop(l_quantity), 6)", r="round(corr(l_quantity, l_extendedprice), 6)", slope="round(regr_slope(l_extendedprice, l_quantity), 4)", top="max(l_discount)")


# -- functions ----------------------------------------------------------------


@query(r"SELECT doc_id, normalized FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\x00-\x7f]', '', 'g'), '\s+', '', 'g') AS normalized FROM documents)")
def normalize_text(spark, sf):
    sql.register(spark)
    return _t(spark, sf, "documents").select("doc_id", F.expr("normalize_text(text)").alias("normalized"))


@query("SELECT nationkey, folded FROM (SELECT n_nationkey AS nationkey, concat('cafe', lower(n_name)) AS folded FROM nation)")
def normalize_text_fold(spark, sf):
    sql.register(spark)
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.expr("normalize_text_fold(concat('Café ', n_name))").alias("folded"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'd', 'g') AS b, split_part(p_brand, '#', 2) AS n, TRY_CAST(p_brand AS INTEGER) AS bad, nullif(p_type, '') AS t, log2(p_size + 1) >= 3 AS big FROM part WHERE p_name ILIKE '%A%'")
def dialect_functions(spark, sf):
    sql.register(spark)
    _views(spark, sf)
    return spark.sql("SELECT p_partkey, regexp_replace_g(p_brand, '[0-9]', 'd', 'g') AS b, split_part(p_brand, '#', 2) AS n, try_cast(p_brand AS INT) AS bad, nullif(p_type, '') AS t, log2(p_size + 1) >= 3 AS big FROM part WHERE p_name ILIKE '%A%'")


# -- document pipelines -------------------------------------------------------


@query("SELECT event_type AS _id, count(*) AS n, round(sum(value), 4) AS total, max(user_id) AS top FROM events WHERE event_type <> 'error' AND regexp_matches(event_type, '(?i)C') GROUP BY 1")
def doc_pipeline_match_group_sort(spark, sf):
    out = docpipe.run(_t(spark, sf, "events"), [
        {"$match": {"event_type": {"$ne": "error", "$regex": "C", "$options": "i"}, "value": {"$exists": True}}},
        {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "total": {"$sum": "$value"}, "top": {"$max": "$user_id"}}},
        {"$sort": {"n": -1}},
    ])
    return out.withColumn("total", F.round("total", 4))


@query("SELECT conv_id, turn, w AS words FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role = 'user' AND turn >= 1)")
def doc_pipeline_unwind(spark, sf):
    return docpipe.run(_t(spark, sf, "conversations"), [
        {"$match": {"role": "user", "turn": {"$gte": 1}}},
        {"$addFields": {"words": {"$split": ["$text", " "]}}},
        {"$unwind": "$words"},
        {"$project": {"conv_id": 1, "turn": 1, "words": 1}},
    ])


@query("SELECT round(avg(k), 6) AS mean, NULL::VARCHAR AS _id FROM (SELECT json_extract_string(props, '$.k')::INTEGER AS k FROM events)")
def doc_pipeline_dotted_path(spark, sf):
    return docpipe.run(_t(spark, sf, "events"), [{"$addFields": {"k": {"$toInt": "$props.k"}}}, {"$group": {"_id": None, "mean": {"$avg": "$k"}}}]).withColumn("mean", F.round("mean", 6))


# -- SQL that sources run themselves ------------------------------------------


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark, sf):
        _views(spark, sf)
        guard.check(spark, text)
        return spark.sql(text)

    query(oracle or text, f"sql_{name}")(run)


_sql("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
_sql("left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7")
_sql("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sql("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_sql("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("theta_join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey < n_nationkey GROUP BY s_suppkey")
_sql("like_join", "SELECT r_name, n_name FROM region JOIN nation ON n_name LIKE '%' || r_regionkey || '%'")
_sql("correlated_latest", "SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
_sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_sql("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
_sql("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
_sql("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("window_rank", "SELECT o_orderkey, o_custkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
_sql("window_frame", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS q FROM lineitem")
_sql("window_ntile", "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bigint) AS q, cast(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS bigint) AS d FROM customer")
_sql("cte", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey), m AS (SELECT avg(v) AS a FROM t) SELECT k FROM t, m WHERE v > 1.5 * a")
_sql("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
_sql("case_coalesce", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, coalesce(nullif(p_type, 'STANDARD'), 'plain') AS t FROM part")
_sql("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("lateral_unnest", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) x AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
# Spark numbers a correlated LIMIT's rows in their order only if the sub-query returns all that it is ordered by; else in the order in which they arrive.
_sql("lateral_subquery", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1) t", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
_sql("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open, 'F' AS filled))", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS open, sum(l_quantity) FILTER (l_linestatus = 'F') AS filled FROM lineitem GROUP BY 1")
_sql("unpivot", "SELECT p_partkey, k, v FROM (SELECT p_partkey, cast(p_size as double) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))", "SELECT p_partkey, 'size' AS k, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
_sql("json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


@query("SELECT l.l_orderkey, l.l_linenumber, n.n_nationkey FROM lineitem l JOIN nation n ON l.l_quantity >= n.n_nationkey * 2 AND l.l_quantity < n.n_nationkey * 2 + 3")
def range_join(spark, sf):
    """Intervals [2k, 2k + 3) against points."""
    points = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    spans = _t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("lo"), (F.col("n_nationkey") * 2 + 3).alias("hi"))
    return ranges.range_join(points, spans, "l_quantity", "lo", "hi").select("l_orderkey", "l_linenumber", "n_nationkey")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 1 - s_suppkey % 7 * 20 AND s_acctbal + s_suppkey % 7 * 20")
def range_join_unlike_lengths(spark, sf):
    """Closed intervals of seven lengths."""
    spans = _t(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal - 1 - s_suppkey % 7 * 20 AS lo", "s_acctbal + s_suppkey % 7 * 20 AS hi")
    return ranges.range_join(_t(spark, sf, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "lo", "hi", closed=True).select("s_suppkey", "p_partkey")


@query("SELECT e.event_id, p.event_id AS before FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf):
    """The last purchase of the same user at or before each event."""
    e = _t(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before"))
    return ranges.asof_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["before"]).select("event_id", "before")


@query("""SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(p.ts) <= 3600 * 1000000::BIGINT THEN p.event_id END AS before FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join_tolerance(spark, sf):
    e = _t(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before"))
    return ranges.asof_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["before"], tolerance=3600).select("event_id", "before")


# -- discovery, profiles, checks ----------------------------------------------


@query("SELECT 'o_custkey' AS column_a, 'c_custkey' AS column_b, 'identity' AS transform, 1.0::DOUBLE AS overlap WHERE (SELECT count(*) FROM orders) > 0")
def detect_transform_overlap(spark, sf):
    """Every order's customer is a customer: overlap under the whole grammar, as one job over all keys."""
    a = _t(spark, sf, "orders").select(F.lit(0).cast("long").alias("pair"), F.lit("a").alias("side"), F.col("o_custkey").cast("string").alias("value"))
    b = _t(spark, sf, "customer").select(F.lit(0).cast("long").alias("pair"), F.lit("b").alias("side"), F.col("c_custkey").cast("string").alias("value"))
    best = discovery.best_transform(a.unionAll(b))
    return best.select(F.lit("o_custkey").alias("column_a"), F.lit("c_custkey").alias("column_b"), "transform", "overlap")


@query("""
WITH x AS (SELECT count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(DISTINCT c_custkey) AS f FROM customer),
y AS (SELECT count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(DISTINCT o_custkey) AS b FROM orders),
z AS (SELECT f, b, f < 0.7 AND b > f AS turned FROM x, y)
SELECT CASE WHEN turned THEN 'sales.orders.o_custkey' ELSE 'crm.customer.c_custkey' END AS a, CASE WHEN turned THEN 'crm.customer.c_custkey' ELSE 'sales.orders.o_custkey' END AS b, 'identity' AS transform,
  (CASE WHEN turned THEN b ELSE f END)::DOUBLE AS overlap, round(0.35 * 0.85 + 0.65 * CASE WHEN turned THEN b ELSE f END, 4)::DOUBLE AS confidence FROM z""")
def discover_joins(spark, sf):
    catalog = SourceCatalog(spark)
    catalog.register("sales", "frames", frames={"orders": _t(spark, sf, "orders")})
    catalog.register("crm", "frames", frames={"customer": _t(spark, sf, "customer").select("c_custkey", "c_name")})
    from .sources.profile import Table, columns_of

    schema = {a: {t: Table(t, columns_of(catalog.table(a, t))) for t in catalog.tables(a)} for a in ("sales", "crm")}
    found = discovery.JoinDiscovery(catalog, sample=None).discover(schema)
    return spark.createDataFrame([(".".join(c.a), ".".join(c.b), c.transform, float(c.overlap), c.confidence) for c in found], "a string, b string, transform string, overlap double, confidence double")


@query("""
SELECT 'c_custkey' AS column, count(*) FILTER (c_custkey IS NULL) AS nulls, count(c_custkey) AS non_null, count(DISTINCT c_custkey) AS distinct_values FROM customer
UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL), count(c_name), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL), count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL), count(c_acctbal), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def profile_columns(spark, sf):
    return profile_rows(_t(spark, sf, "customer"))


@query("""SELECT * FROM (VALUES ('SELECT 1', 'ok'), ('INSERT INTO t SELECT 1', 'WRITE_OPERATION'), ('DELETE FROM t', 'WRITE_OPERATION'), ('DROP TABLE t', 'DDL_OPERATION'), ('SELECT 1; SELECT 2', 'MULTIPLE_STATEMENTS'), ('SELEC 1', 'PARSE_ERROR')) v(statement, verdict)""")
def read_only_guard(spark, sf):
    rows = []
    for s in ("SELECT 1", "INSERT INTO t SELECT 1", "DELETE FROM t", "DROP TABLE t", "SELECT 1; SELECT 2", "SELEC 1"):
        try:
            guard.check(spark, s)
            rows.append((s, "ok"))
        except guard.SafetyViolation as e:
            rows.append((s, e.kind))
    return spark.createDataFrame(rows, "statement string, verdict string")


# -- event time ---------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark, sf):
    return windows.tumbling(_t(spark, sf, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*")})


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, user_id, count(*) AS n FROM y GROUP BY user_id, k""")
def window_session(spark, sf):
    return windows.sessions(_t(spark, sf, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count("*")})


@query("SELECT count(*) AS rows, count(DISTINCT key) AS keys FROM (SELECT CASE WHEN length(c_custkey::VARCHAR) < 7 THEN lpad(c_custkey::VARCHAR, 7, '0') ELSE c_custkey::VARCHAR END AS key FROM customer)")
def key_grammar(spark, sf):
    c = _t(spark, sf, "customer").select(keys.apply("zfill_7", F.col("c_custkey").cast("string")).alias("key"))
    return c.agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"))


from . import engine_queries  # noqa: E402

QUERIES |= engine_queries.QUERIES
ORACLE_SQL |= engine_queries.ORACLE_SQL
