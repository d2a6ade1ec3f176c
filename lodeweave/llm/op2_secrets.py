"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings are matches of ``assign``, ``access`` and ``hex``. Weak parts
(account identifiers, random-looking tokens, endpoints) are no findings by
themselves: an interval join within each document's scopes (``REACH`` code
points to either side of a part) reports

* an identifier beside a secret (strong or a token),
* a token beside an identifier (an access key or a weak one),
* an endpoint beside both.

A weak part that overlaps a strong finding is the same finding and not reported
again. Parts stay in their document's row, so nothing is shuffled and a document
with many parts holds up its own row alone. One side of the join is indexed: its
intervals, in order, stand in blocks of about the square root of their number,
each with its bounds, and a part looks into the blocks that it can reach. Where a
match stands follows from splitting the text at the pattern: the lengths of what
lies between the matches and of the matches themselves add up to the places, in
blocks too. So n parts cost about n ** 1.5 steps, never n ** 2.

Defined results: null and empty texts have no spans, and the digest is that of
the empty string; texts are read whole, however long, and redacted in cuts of
``CUT`` code points; spans of one start are in the order of their kinds, then of
their ends; repeated rows give equal rows; an empty table gives no rows; other
columns stay, whatever their names, unless an output has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REACH = 256
CUT = 1 << 16

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?i:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|tenant[_-]?id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{4,}"""
TOKEN = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""(?i:https?|wss?|ftp|amqp|redis|mongodb|postgres(?:ql)?|mysql)://[^\s"'<>|]{4,}"""

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
_EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _blocks(array: str) -> str:
    """An array cut into arrays of about the square root of its size."""
    size = f"greatest(16, cast(ceil(sqrt(size({array}))) as int))"
    return f"transform(sequence(0, cast((size({array}) - 1) / {size} as int)), b -> slice({array}, b * {size} + 1, {size}))"


def _array(text: str, pattern: str, kind: str, keep: str = "true") -> Column:
    """Spans of a pattern's leftmost matches that don't overlap and for whose text, ``m``, ``keep`` holds."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    n = KINDS.index(kind)
    return F.expr(f"""
        case when rlike({text}, '{quoted}') then
          aggregate(
            element_at(transform(array(arrays_zip(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0))), z -> {_blocks("z")}), 1),
            named_struct('at', 0, 'out', {_EMPTY}),
            (acc, block) -> element_at(transform(
              array(aggregate(block, named_struct('at', acc.at, 'out', {_EMPTY}),
                (own, x) -> named_struct(
                  'at', own.at + length(x.`0`) + coalesce(length(x.`1`), 0),
                  'out', case when x.`1` is not null and ({keep.replace("@m", "x.`1`")})
                         then concat(own.out, array(named_struct('start', own.at + length(x.`0`), 'kind', {n}, 'end', own.at + length(x.`0`) + length(x.`1`))))
                         else own.out end))),
              r -> named_struct('at', r.at, 'out', concat(acc.out, r.out))), 1),
            acc -> acc.out)
        else {_EMPTY} end""")


def _indexed(parts: str) -> Column:
    """Blocks of intervals in order of their starts, each with the bounds of what it holds."""
    return F.expr(f"""
        case when size({parts}) = 0 then cast(array() as array<struct<lo:int,hi:int,items:array<struct<start:int,kind:int,end:int>>>>)
        else transform({_blocks(parts)}, items -> named_struct('lo', items[0].start, 'hi', array_max(transform(items, p -> p.end)), 'items', items)) end""")


def _within(index: str, reach: int = 0) -> str:
    """Condition that an interval of ``index`` overlaps ``w`` widened by ``reach``."""
    near = f"start < w.end + {reach} and p.end > w.start - {reach}"
    return f"exists({index}, b -> b.lo < w.end + {reach} and b.hi > w.start - {reach} and exists(b.items, p -> p.{near}))"


def _found(df: DataFrame) -> DataFrame:
    """``row`` and ``t`` of ``df`` with ``strong`` and ``linked``."""
    quoted = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    found = df.select(
        "row",
        "t",
        _array("t", ASSIGN, "assign", f"length(regexp_extract(@m, '{quoted}', 2)) >= 6").alias("assign"),
        _array("t", ACCESS, "access").alias("access"),
        _array("t", HEX, "hex").alias("hex"),
        _array("t", IDENTIFIER, "identifier").alias("identifier"),
        _array("t", TOKEN, "token", "rlike(@m, '[0-9]') and rlike(@m, '[a-z]') and rlike(@m, '[A-Z]')").alias("token"),
        _array("t", ENDPOINT, "endpoint").alias("endpoint"),
    )
    # A column that only a lambda uses would be computed within it, for each part; so the condition ahead uses it too.
    found = found.withColumn("strong", F.array_sort(F.concat("assign", "access", "hex")))
    found = found.withColumn("known", _indexed("strong"))
    for weak in ("identifier", "token", "endpoint"):
        found = found.withColumn(weak, F.expr(f"case when size({weak}) > 0 and size(known) > 0 then filter({weak}, w -> not {_within('known')}) else {weak} end"))
    found = found.withColumn("secrets", F.array_sort(F.concat("assign", "hex", "token"))).withColumn("ids", F.array_sort(F.concat("access", "identifier")))
    found = found.withColumn("by_secret", _indexed("secrets")).withColumn("by_id", _indexed("ids"))
    near_secret, near_id = _within("by_secret", REACH), _within("by_id", REACH)
    some = "size(by_secret) > 0 and size(by_id) > 0"
    none = _EMPTY
    linked = F.expr(f"""concat(
        case when {some} then filter(identifier, w -> {near_secret}) else {none} end,
        case when {some} then filter(token, w -> {near_id}) else {none} end,
        case when {some} then filter(endpoint, w -> {near_secret} and {near_id}) else {none} end)""")
    return found.select("row", "t", "strong", F.array_sort(linked).alias("linked"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``strong`` and ``linked``: arrays of spans (``start``, ``kind`` as an index of ``KINDS``, ``end``; code points, end exclusive), in order."""
    # The input's columns stand in a struct of their own, so that no name of theirs meets one of these.
    row = F.struct(*(df[c] for c in common.others(df, ("strong", "linked"))))
    return _found(df.select(row.alias("row"), F.coalesce(df[text], F.lit("")).alias("t"))).select("row.*", "strong", "linked")


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with ``mark`` in place of each found span in ``text``; overlapping spans count as one. Null texts stay null."""
    found = _found(df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.coalesce(df[text], F.lit("")).alias("t")))
    found = found.withColumn("spans", F.array_sort(F.concat("strong", "linked")))
    # Cut by cut: a place within a text is found by counting its characters from the start.
    cut = F.expr(f"""
        case when size(spans) > 0 and length(t) > 0 then
          array_join(transform(
            transform(sequence(0, cast((length(t) - 1) / {CUT} as int)), i -> named_struct('from', i * {CUT}, 'part', substring(t, i * {CUT} + 1, {CUT}))),
            c -> aggregate(filter(spans, s -> s.end > c.from and s.start < c.from + {CUT}), named_struct('at', c.from, 'out', ''),
              (acc, s) -> case
                when s.end <= acc.at then acc
                when s.start < acc.at then named_struct('at', s.end, 'out', acc.out)
                else named_struct('at', s.end, 'out', concat(acc.out, substring(c.part, acc.at - c.from + 1, s.start - acc.at), '{mark}')) end,
              acc -> concat(acc.out, substring(c.part, acc.at - c.from + 1, {CUT})))), '')
        end""")
    clean = found.withColumn("clean", cut)
    return clean.select(*(F.coalesce(F.col("clean"), F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("strong", "linked"))).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _sql_spans(pattern: str, kind: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {KINDS.index(kind)} AS kind, a, a + length(m[i]) AS b FROM (
    SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM (
      SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(s, '{p}') AS p, regexp_extract_all(s, '{p}') AS m FROM t) WHERE len(m) > 0))
  WHERE {keep.replace("@m", "m[i]")}"""


def _sql_beside(kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.kind IN ({kinds}) AND p.a < w.b + {REACH} AND p.b > w.a - {REACH})"


_QUOTED = ASSIGN.replace("'", "''")
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
strong AS ({_sql_spans(ASSIGN, "assign", f"length(regexp_extract(@m, '{_QUOTED}', 2)) >= 6")}
  UNION ALL {_sql_spans(ACCESS, "access")}
  UNION ALL {_sql_spans(HEX, "hex")}),
weak AS (SELECT * FROM ({_sql_spans(IDENTIFIER, "identifier")}
  UNION ALL {_sql_spans(TOKEN, "token", "regexp_matches(@m, '[0-9]') AND regexp_matches(@m, '[a-z]') AND regexp_matches(@m, '[A-Z]')")}
  UNION ALL {_sql_spans(ENDPOINT, "endpoint")}) w
  WHERE NOT EXISTS (SELECT 1 FROM strong p WHERE p.doc_id = w.doc_id AND p.a < w.b AND p.b > w.a)),
parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE (kind = 3 AND {_sql_beside("0, 2, 4")}) OR (kind = 4 AND {_sql_beside("1, 3")}) OR (kind = 5 AND {_sql_beside("0, 2, 4")} AND {_sql_beside("1, 3")})),
named AS (SELECT doc_id, kind, a, b, list_extract({list(KINDS)}, kind + 1) || ':' || a || ':' || b AS x FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked)),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY a, kind, b) FILTER (kind < 3), '') AS base, string_agg(x, ',' ORDER BY a, kind, b) AS spans FROM named GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s ON t.doc_id = s.doc_id
"""
