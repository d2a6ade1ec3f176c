"""Joins on ranges and on time: values within intervals, and the last row at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import quoted


def range_join(points: DataFrame, spans: DataFrame, value: str, low: str, high: str, closed: bool = False) -> DataFrame:
    """Each point with each interval from ``low`` to below ``high`` (up to it with ``closed``) that holds its ``value``; both sides' columns.

    An interval's level is its length's power of two, and it stands in the two
    or three buckets of that width that it touches; a point looks into one bucket
    of each level there is. So the join is on equal keys, however unlike the
    lengths are, and AQE can split a bucket that is hot. The driver gets the
    levels alone, which number some tens. Nulls and empty intervals join nothing.
    """
    v, lo, hi = (F.col(quoted(c)).cast("double") for c in (value, low, high))
    level = F.ceil(F.log2(F.greatest(hi - lo, F.lit(2.0**-40)))).cast("int")
    usable = spans.where((hi >= lo) if closed else (hi > lo)).withColumn("__level", level)
    levels = sorted(r[0] for r in usable.select("__level").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("__level"))
    bucketed = usable.withColumn("__bucket", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    keys = F.array(*(F.struct(F.lit(k).alias("__level"), F.floor(v / F.lit(2.0**k)).alias("__bucket")) for k in levels)) if levels else F.array().cast("array<struct<__level:int,__bucket:bigint>>")
    probes = points.where(v.isNotNull()).withColumn("__key", F.explode(keys)).select(*(F.col(quoted(c)) for c in points.columns), "__key.*")
    inside = (v >= lo) & ((v <= hi) if closed else (v < hi))
    return probes.join(bucketed, ["__level", "__bucket"]).where(inside).drop("__level", "__bucket")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tolerance: float | None = None, bucket: float = 86_400.0) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with the same ``by`` at or before ``left_time``; null where there is none, or none within ``tolerance`` seconds.

    Of rows at one time the one with the greatest ``columns`` counts. Times are
    cut into buckets of ``bucket`` seconds: rows are sorted within key and
    bucket, and one row for each key and bucket carries the last values on to
    the next, so a key's whole history is never one task's.
    """
    keys = [F.col(quoted(c)) for c in by]
    seconds = lambda c: F.unix_micros(F.col(quoted(c)).cast("timestamp")) / 1e6
    names = [f"__by{i}" for i in range(len(by))]
    named = [k.alias(n) for k, n in zip(keys, names, strict=True)]
    row = F.struct(*(F.col(quoted(c)) for c in left.columns)).alias("__row")
    found = F.struct(seconds(right_time).alias("t"), *(F.col(quoted(c)) for c in columns)).alias("__found")
    a = left.select(*named, seconds(left_time).alias("__t"), row)
    b = right.where(F.col(quoted(right_time)).isNotNull()).select(*named, seconds(right_time).alias("__t"), found)
    both = a.withColumn("__found", F.lit(None).cast(b.schema["__found"].dataType)).unionByName(b.withColumn("__row", F.lit(None).cast(a.schema["__row"].dataType)))
    both = both.withColumn("__bucket", F.floor(F.col("__t") / bucket))
    inside = W.partitionBy(*names, "__bucket").orderBy("__t").rangeBetween(W.unboundedPreceding, 0)
    own = both.withColumn("__found", F.max("__found").over(inside)).where("__row is not null")
    last = both.groupBy(*names, "__bucket").agg(F.max("__found").alias("__last"))
    ahead = W.partitionBy(*names).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*(F.col(n).alias(f"{n}c") for n in names), F.col("__bucket").alias("__bc"), F.max("__last").over(ahead).alias("__carried"))
    same = F.col("__bucket").eqNullSafe(F.col("__bc"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}c"))
    joined = own.join(carried, same, "left")
    value = F.coalesce("__found", "__carried")
    if tolerance is not None:
        value = F.when(F.col("__t") - value["t"] <= tolerance, value)
    return joined.withColumn("__value", value).select("__row.*", *(F.col("__value")[c].alias(c) for c in columns))
