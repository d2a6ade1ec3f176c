"""A SparkSession with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodeweave", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow. What a cluster has set stays unless ``conf`` names it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
