"""Append-only audit log in Parquet."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, session_id string, at timestamp, query string, databases array<string>, row_count long, execution_ms double, plausibility_score double, warnings array<string>, truncated boolean, estimated_cost double"


class AuditLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._last: int | None = None

    def read(self) -> DataFrame:
        if not os.path.exists(self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def record(self, session_id: str, query: str, databases: list[str], row_count: int, execution_ms: float, plausibility_score: float | None = None, warnings: list[str] | None = None, truncated: bool = False, estimated_cost: float | None = None) -> int:
        if self._last is None:
            self._last = self.read().agg(F.max("id")).first()[0] or 0
        self._last += 1
        row = (self._last, session_id, datetime.datetime.now(), query, list(databases), row_count, float(execution_ms), plausibility_score, list(warnings or []), truncated, estimated_cost)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return self._last

    def get_session(self, session_id: str) -> list[dict]:
        return [r.asDict() for r in self.read().where(F.col("session_id") == session_id).orderBy("at", "id").collect()]

    def recent(self, n: int = 20) -> list[dict]:
        return [r.asDict() for r in self.read().orderBy(F.desc("id")).limit(n).collect()]

    def replay(self, entry: int) -> dict | None:
        """The entry as recorded; nothing runs again."""
        row = self.read().where(F.col("id") == entry).first()
        return row.asDict() if row else None
