"""Join keys between sources: name similarity, overlap of sampled values under the key grammar, detection in results."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.text import as_string, quoted, strip
from ..sources.catalog import SourceCatalog
from ..sources.profile import Table

NAME_THRESHOLD, OVERLAP_THRESHOLD, LEAST_CONFIDENCE, SAMPLE, DETECT_ROWS = 0.70, 0.70, 0.60, 50, 500

# Name parts that say nothing, and groups of names that mean one thing.
GENERIC = frozenset({"id", "code", "num", "no", "ref", "key", "cd", "fk"})
SYNONYMS = [
    {"id", "_id", "uid", "pk", "ref", "key"},
    {"ts", "timestamp", "created_at", "updated_at", "datetime", "date"},
    {"amt", "amount", "total", "sum", "price", "cost", "value"},
    {"qty", "quantity", "count", "num", "number"},
    {"addr", "address", "street", "location"},
    {"dob", "birth_date", "birthdate", "birth_day", "date_of_birth"},
    {"fname", "first_name", "given_name", "forename"},
    {"lname", "last_name", "surname", "family_name"},
]


def name_tokens(name: str) -> list[str]:
    parts = [p for p in re.split(r"[_\s]+", name.lower()) if p]
    kept = [p for p in parts if p not in GENERIC]
    return kept or parts


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def name_similarity(a: str, b: str, synonyms: list[set] = SYNONYMS) -> float:
    """0 to 1: twice the common subsequence of the sorted parts over their length; at least 0.85 for synonyms."""
    x, y = name_tokens(a), name_tokens(b)
    s, t = " ".join(sorted(x)), " ".join(sorted(y))
    score = 2 * _common(s, t) / (len(s) + len(t)) if s or t else 1.0
    wide = [{*p, "_".join(p)}.union(*(g for g in synonyms if g & {*p, "_".join(p)})) for p in (x, y)]
    return max(score, 0.85) if wide[0] & wide[1] else score


def confidence(similarity: float, overlap: float) -> float:
    return round(0.35 * similarity + 0.65 * overlap, 4)


def _same(c: Column) -> Column:
    """Keys that differ only in case, separators or leading zeros are one key."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)[-_\s]", "")), "^0+(?=.)", "")


def overlaps(pairs: DataFrame) -> DataFrame:
    """``pair, transform, place, overlap`` for values ``pair, side, value``: the share of transformed values of side a that side b has.

    Where a transform makes different keys of side a equal, the share is of the keys, so that a few
    endings that all keys share are no match. All pairs and all transforms are one job.
    """
    text = F.col("value")
    forms = [*((n, f(text)) for n, f in keys.GRAMMAR.items()), (None, _same(text))]
    a = pairs.where("side = 'a' and value is not null").select("pair", "value").distinct().select("pair", F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).cast("string").alias("transform"), v.alias("v")) for i, (n, v) in enumerate(forms)))).alias("x")).select("pair", "x.*").distinct()
    b = pairs.where("side = 'b' and value is not null").select("pair", strip(text).alias("v")).distinct().withColumn("hit", F.lit(1))
    counts = a.join(b, ["pair", "v"], "left").groupBy("pair", "transform", "place").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    known = F.max(F.when(F.col("transform").isNull(), F.col("n"))).over(W.partitionBy("pair"))
    return counts.withColumn("keys", known).where("transform is not null").select("pair", "transform", "place", (F.col("hits") / F.greatest("n", "keys")).alias("overlap"))


def best_transform(pairs: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """``pair, transform, overlap`` of the best transform, the earliest of equals; below ``threshold`` it has no name."""
    best = overlaps(pairs).groupBy("pair").agg(F.max_by(F.struct("transform", "overlap"), F.struct("overlap", -F.col("place"))).alias("x"))
    return best.select("pair", F.when(F.col("x.overlap") >= threshold, F.col("x.transform")).alias("transform"), F.col("x.overlap").alias("overlap"))


def detect_transform(spark: SparkSession, a: list, b: list, threshold: float = OVERLAP_THRESHOLD) -> tuple[str | None, float]:
    rows = [(0, s, str(v)) for s, values in (("a", a), ("b", b)) for v in values if v is not None]
    if not a or not b or not rows:
        return None, 0.0
    row = best_transform(spark.createDataFrame(rows, "pair long, side string, value string"), threshold).first()
    return (None, 0.0) if row is None else (row["transform"], row["overlap"])


@dataclass(frozen=True)
class Candidate:
    a: tuple[str, str, str]
    b: tuple[str, str, str]
    name_similarity: float
    overlap: float
    transform: str | None
    confidence: float

    @property
    def id(self) -> str:
        return f"{'.'.join(self.a)}__{'.'.join(self.b)}"


class JoinDiscovery:
    def __init__(self, catalog: SourceCatalog, name_threshold: float = NAME_THRESHOLD, overlap_threshold: float = OVERLAP_THRESHOLD, least_confidence: float = LEAST_CONFIDENCE, sample: int | None = SAMPLE):
        """``sample`` bounds the rows of each column; with None every value counts."""
        self.catalog, self.name_threshold, self.overlap_threshold, self.least, self.sample = catalog, name_threshold, overlap_threshold, least_confidence, sample

    def _values(self, pairs: list[tuple[tuple, tuple]]) -> DataFrame:
        parts = []
        for i, sides in enumerate(pairs):
            for side, (alias, table, column) in zip("ab", sides, strict=True):
                df = self.catalog.table(alias, table)
                df = df.where(F.col(quoted(column)).isNotNull())
                df = df if self.sample is None else df.limit(self.sample)
                parts.append(df.select(F.lit(i).cast("long").alias("pair"), F.lit(side).alias("side"), as_string(df, column).alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def _scored(self, pairs: list[tuple[tuple, tuple]]) -> dict[int, tuple[str | None, float]]:
        return {r["pair"]: (r["transform"], r["overlap"]) for r in best_transform(self._values(pairs), self.overlap_threshold).collect()} if pairs else {}

    def discover(self, schema: dict[str, dict[str, Table]], suggest: Callable[[tuple, tuple, list, list], str | None] | None = None) -> list[Candidate]:
        """Candidates between columns of different sources, best first. ``suggest`` may name a transform for pairs of similar names whose values don't overlap."""
        pairs = []
        for x, y in combinations(sorted(schema), 2):
            for ta in schema[x].values():
                for tb in schema[y].values():
                    pairs += [((x, ta.name, a.name), (y, tb.name, b.name)) for a in ta.columns for b in tb.columns if name_similarity(a.name, b.name) >= self.name_threshold]
        forward = self._scored(pairs)
        weak = [i for i in range(len(pairs)) if forward.get(i, (None, 0.0))[1] < self.overlap_threshold]
        backward = self._scored([pairs[i][::-1] for i in weak])
        out = []
        for i, (a, b) in enumerate(pairs):
            transform, overlap = forward.get(i, (None, 0.0))
            if i in weak:
                other = backward.get(weak.index(i), (None, 0.0))
                if other[1] > overlap:
                    a, b, (transform, overlap) = b, a, other
            similarity = name_similarity(a[2], b[2])
            score = confidence(similarity, overlap)
            if score < self.least and similarity >= 0.80 and suggest:
                left, right = (self.catalog.sample_column(*side, self.sample or SAMPLE) for side in (a, b))
                name = suggest(a, b, left, right)
                if name in keys.GRAMMAR:
                    found = {r["transform"]: r["overlap"] for r in overlaps(self._values([(a, b)])).collect()}
                    if found.get(name, 0.0) >= self.overlap_threshold:
                        transform, overlap = name, found[name]
                        score = confidence(similarity, overlap)
            if score >= self.least:
                out.append(Candidate(a, b, similarity, overlap, transform, score))
        return sorted(out, key=lambda c: -c.confidence)

    def verify(self, rules: list) -> list[tuple]:
        """Rules with their present confidence and transform, the better of both directions; rules of tables that are gone are left out."""
        known = [r for r in rules if r.db_a in self.catalog.sources and r.db_b in self.catalog.sources and r.table_a in self.catalog.tables(r.db_a) and r.table_b in self.catalog.tables(r.db_b)]
        pairs = [((r.db_a, r.table_a, r.column_a), (r.db_b, r.table_b, r.column_b)) for r in known]
        forward, backward = self._scored(pairs), self._scored([p[::-1] for p in pairs])
        out = []
        for i, r in enumerate(known):
            transform, overlap = max(forward.get(i, (None, 0.0)), backward.get(i, (None, 0.0)), key=lambda x: x[1])
            out.append((r, confidence(name_similarity(r.column_a, r.column_b), overlap), transform))
        return out


@dataclass(frozen=True)
class Match:
    column_a: str
    column_b: str
    transform: str
    transform_sql: str
    overlap: float


def _prefixed(name: str):
    return lambda k, v: F.concat(F.lit(name + "__"), k)


def _stacked(df: DataFrame, side: str, fields: bool) -> DataFrame:
    """``col, value`` of up to ``DETECT_ROWS`` rows; fields of objects in text are columns ``parent__field`` of side b."""
    df = df.limit(DETECT_ROWS)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    entries = [F.map_from_arrays(F.array(*map(F.lit, plain)), F.array(*(as_string(df, c) for c in plain)))]
    for f in df.schema.fields:
        if fields and isinstance(f.dataType, T.StringType):
            c = F.col(quoted(f.name))
            inner = F.when(strip(c).startswith("{"), F.from_json(c, "map<string,string>"))
            entries.append(F.transform_keys(F.coalesce(F.map_filter(inner, lambda k, v: ~v.rlike(r"^\s*[\[{]")), F.create_map().cast("map<string,string>")), _prefixed(f.name)))
    return df.select(F.explode(F.map_concat(*entries)).alias("col", "value")).where("value is not null").withColumn("side", F.lit(side))


def detect_join(a: DataFrame, b: DataFrame, least: float = 0.90) -> Match | None:
    """The columns of two results that join best, each brought to one form on both sides.

    Columns of fractions are left out, and so are digit forms where a side is
    whole numbers; a side needs three different values, and the side with keys
    needs at least 15 % different raw values.
    """
    values = _stacked(a, "a", False).unionAll(_stacked(b, "b", True))
    number = r"^[+-]?\d+\.\d*[1-9]\d*$"
    about = values.groupBy("side", "col").agg(F.avg(F.col("value").rlike(number).cast("double")).alias("fractions"), F.min(F.col("value").rlike(r"^[+-]?\d+$")).alias("whole"), (F.count_distinct("value") / F.count("*")).alias("unique"))
    usable = values.join(about, ["side", "col"]).where("fractions <= 0.2")
    forms = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("transform"), f(F.col("value")).alias("v")) for i, (n, f) in enumerate(keys.GRAMMAR.items()))))
    sets = usable.select("side", "col", "whole", "unique", forms.alias("x")).groupBy("side", "col", "whole", "unique", "x.place", "x.transform").agg(F.collect_set("x.v").alias("s")).where(F.size("s") >= 3)
    x, y = sets.where("side = 'a'").alias("x"), sets.where("side = 'b'").alias("y")
    digit_forms = F.col("x.transform").isin("extract_digits", "zfill_5", "zfill_7")
    both = x.join(y, F.col("x.transform") == F.col("y.transform")).where(~(digit_forms & (F.col("x.whole") | F.col("y.whole"))))
    shared = F.size(F.array_intersect("x.s", "y.s"))
    cover_a, cover_b = shared / F.size("x.s"), shared / F.size("y.s")
    keyed = F.when(cover_a >= cover_b, F.col("x.unique")).otherwise(F.col("y.unique"))
    scored = both.select(F.col("x.col").alias("a"), F.col("y.col").alias("b"), F.col("x.transform").alias("t"), F.col("x.place").alias("p"), F.greatest(cover_a, cover_b).alias("o"), keyed.alias("u")).where((F.col("u") >= 0.15) & (F.col("o") > least - 0.001))
    row = scored.orderBy(F.desc("o"), "p", "a", "b").first()
    return Match(row["a"], row["b"], row["t"], keys.transform_sql(row["t"], row["a"]), row["o"]) if row else None
