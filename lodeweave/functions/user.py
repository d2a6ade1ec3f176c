"""Functions of the user's own, for the engine's SQL: on columns, on groups, and giving tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable, kind: str) -> None:
    """``f`` takes and gives pandas series, a batch at a time."""
    spark.udf.register(name, F.pandas_udf(f, kind))


def aggregate(spark: SparkSession, name: str, f: Callable, kind: str) -> None:
    """``f`` takes a group's pandas series, as its annotations say, and gives one value."""
    spark.udf.register(name, F.pandas_udf(f, kind))


def table(spark: SparkSession, name: str, handler: type, schema: str) -> None:
    """``handler.eval`` yields rows for each call, also beside a table by ``LATERAL``."""
    spark.udtf.register(name, F.udtf(handler, returnType=schema))
