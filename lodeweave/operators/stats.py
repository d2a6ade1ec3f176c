"""Statistics over whole results: chi-square of a contingency table, and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import as_number, column, has, quoted, as_string
from .transforms import compute_ema


def cells(df: DataFrame, row_col: str, col_col: str, count_col: str | None = "count", min_marginal: float = 0) -> DataFrame:
    """``r, c, o, rm, cm, kept``: each observed cell with its marginals, of rows and columns whose own exceed ``min_marginal`` where ``kept``.

    A missing count is one observation; a missing label is a label of its own.
    """
    label = lambda name: F.coalesce(as_string(df, name), F.lit("None")) if has(df, name) else F.lit("")
    if count_col and has(df, count_col):
        n = F.when(column(df, count_col).isNull(), F.lit(1.0)).otherwise(F.coalesce(as_number(df, count_col), F.lit(1.0)))
    else:
        n = F.lit(1.0)
    observed = df.select(label(row_col).alias("r"), label(col_col).alias("c"), n.alias("o")).groupBy("r", "c").agg(F.sum("o").alias("o"))
    by_row, by_col = W.partitionBy("r"), W.partitionBy("c")
    out = observed.withColumn("ra", F.sum("o").over(by_row)).withColumn("ca", F.sum("o").over(by_col))
    out = out.withColumn("kept", (F.col("ra") > min_marginal) & (F.col("ca") > min_marginal))
    kept = F.when(F.col("kept"), F.col("o"))
    return out.withColumn("cm", F.sum(kept).over(by_col)).withColumn("rm", F.sum(kept).over(by_row))


def chi_square(df: DataFrame, row_col: str, col_col: str, count_col: str | None = "count", min_marginal: float = 0) -> DataFrame:
    """One row: ``chi_square, grand_total, rows_included, cols_included, rows_excluded, cols_excluded, dof``; null where the total is zero.

    Cells that nobody observed need no rows: a cell expects ``rm * cm / N``, all
    cells together expect N, so the empty ones add N less what the others expect.
    """
    grid = cells(df, row_col, col_col, count_col, min_marginal)
    total = grid.agg(F.sum(F.when(F.col("kept"), F.col("o"))).alias("n"))
    e = F.try_divide(F.col("rm") * F.col("cm"), F.col("n"))
    out = grid.crossJoin(F.broadcast(total)).withColumn("e", F.when(F.col("kept"), e)).agg(  # one row
        F.sum(F.try_divide((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.col("e"))).alias("near"),
        F.sum("e").alias("expected"),
        F.max("n").alias("n"),
        F.count_distinct(F.when(F.col("kept"), F.col("r"))).alias("rows_included"),
        F.count_distinct(F.when(F.col("kept"), F.col("c"))).alias("cols_included"),
        (F.count_distinct("r") - F.count_distinct(F.when(F.col("kept"), F.col("r")))).alias("rows_excluded"),
        (F.count_distinct("c") - F.count_distinct(F.when(F.col("kept"), F.col("c")))).alias("cols_excluded"),
    )
    value = F.when(F.col("n") != 0, F.col("near") + F.col("n") - F.col("expected")).alias("chi_square")
    names = ("rows_included", "cols_included", "rows_excluded", "cols_excluded")
    return out.select(value, F.coalesce("n", F.lit(0)).cast("bigint").alias("grand_total"), *names, ((F.col("rows_included") - 1) * (F.col("cols_included") - 1)).alias("dof"))


def ema(df: DataFrame, group_col: str, sort_col: str, value_col: str, alpha: float = 0.3, fill_gaps: bool = True, summarize: bool = True) -> DataFrame:
    """The same average as the transform, with groups as texts and the greatest average first."""
    named = df.withColumn(group_col, F.coalesce(as_string(df, group_col), F.lit("None")))
    return compute_ema(named.select(*(F.col(quoted(c)) for c in (group_col, sort_col, value_col))), group_col, sort_col, value_col, alpha, "ema", fill_gaps, summarize, by_value=True)


def expression(df: DataFrame, **named: str) -> DataFrame:
    """Aggregate SQL expressions over the whole result, one row."""
    return df.agg(*(F.expr(e).alias(name) for name, e in named.items()))
