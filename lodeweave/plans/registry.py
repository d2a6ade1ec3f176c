"""Registry of join rules: an append-only log in Parquet of which the last entry of each rule counts."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

_SCHEMA = "join_id string, db_a string, table_a string, column_a string, db_b string, table_b string, column_b string, transform string, confidence double, confirmed boolean, success_count int, failure_count int, verified_by string, deleted boolean, at double"
RELIABLE = 0.70


@dataclass(frozen=True)
class JoinRule:
    db_a: str
    table_a: str
    column_a: str
    db_b: str
    table_b: str
    column_b: str
    transform: str | None = None
    confidence: float = 0.5
    confirmed: bool = False
    success_count: int = 0
    failure_count: int = 0
    verified_by: str | None = None
    join_id: str = ""

    def __post_init__(self):
        if not self.join_id:
            ends = sorted([f"{self.db_a}.{self.table_a}.{self.column_a}", f"{self.db_b}.{self.table_b}.{self.column_b}"])
            object.__setattr__(self, "join_id", hashlib.sha256("__".join(ends).encode()).hexdigest()[:16])

    @property
    def is_reliable(self) -> bool:
        return self.confirmed and self.confidence >= RELIABLE

    def flipped(self) -> JoinRule:
        return replace(self, db_a=self.db_b, table_a=self.table_b, column_a=self.column_b, db_b=self.db_a, table_b=self.table_a, column_b=self.column_a)


def recorded(rule: JoinRule, success: bool) -> JoinRule:
    """A success adds 0.02, to 1 at most; a failure takes 0.05, to 0 at least."""
    if success:
        return replace(rule, confidence=round(min(1.0, rule.confidence + 0.02), 10), success_count=rule.success_count + 1)
    return replace(rule, confidence=round(max(0.0, rule.confidence - 0.05), 10), failure_count=rule.failure_count + 1)


class JoinRegistry:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self._rules: dict[str, JoinRule] = {}
        self._clock = 0.0
        if path and os.path.exists(path):
            names = [f.name for f in fields(JoinRule)]
            for row in sorted(spark.read.schema(_SCHEMA).parquet(path).collect(), key=lambda r: r["at"]):
                if row["deleted"]:
                    self._rules.pop(row["join_id"], None)
                else:
                    self._rules[row["join_id"]] = JoinRule(**{n: row[n] for n in names})

    def _log(self, rules: list[JoinRule], deleted: bool = False) -> None:
        if self.path and rules:
            rows = []
            for r in rules:
                self._clock = max(time.time(), self._clock + 1e-6)
                rows.append({**asdict(r), "deleted": deleted, "at": self._clock})
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def save(self, rule: JoinRule) -> JoinRule:
        self._rules[rule.join_id] = rule
        self._log([rule])
        return rule

    def save_if_new(self, rule: JoinRule) -> bool:
        if rule.join_id in self._rules:
            return False
        self.save(rule)
        return True

    def get(self, join_id: str) -> JoinRule | None:
        return self._rules.get(join_id)

    def get_all(self, confirmed_only: bool = False) -> list[JoinRule]:
        return sorted((r for r in self._rules.values() if r.confirmed or not confirmed_only), key=lambda r: -r.confidence)

    def confirm(self, join_id: str, by: str = "user") -> bool:
        return bool(self._change(join_id, confirmed=True, verified_by=by))

    def reject(self, join_id: str) -> bool:
        rule = self._rules.pop(join_id, None)
        if rule:
            self._log([rule], deleted=True)
        return rule is not None

    def _change(self, join_id: str, **values) -> JoinRule | None:
        return self.save(replace(self._rules[join_id], **values)) if join_id in self._rules else None

    def record_outcome(self, join_id: str, success: bool) -> JoinRule | None:
        return self.save(recorded(self._rules[join_id], success)) if join_id in self._rules else None

    def find_for_tables(self, db_a: str, table_a: str, db_b: str, table_b: str) -> list[JoinRule]:
        """Rules between two tables in either orientation, turned so that a is a."""
        out = []
        for r in self.get_all():
            if (r.db_a, r.table_a, r.db_b, r.table_b) == (db_a, table_a, db_b, table_b):
                out.append(r)
            elif (r.db_b, r.table_b, r.db_a, r.table_a) == (db_a, table_a, db_b, table_b):
                out.append(r.flipped())
        return out

    def replace_for_tables(self, db_a: str, table_a: str, db_b: str, table_b: str, rules: list[JoinRule]) -> None:
        for r in self.find_for_tables(db_a, table_a, db_b, table_b):
            self.reject(r.join_id)
        for r in rules:
            self.save(r)

    def observe(self, applied: list[str], row_count: int) -> None:
        """A rule that gave rows has done well."""
        for join_id in applied:
            self.record_outcome(join_id, row_count > 0)

    def propose(self, ends: tuple[str, str, str, str, str, str], transform: str | None = None, seen_rows: bool = True) -> JoinRule:
        """A rule for a join that a query spelled out: reinforced if known, else unconfirmed at 0.65, or at 0.6 without rows."""
        rule = JoinRule(*ends, transform=transform, confidence=0.65 if seen_rows else 0.6, success_count=int(seen_rows))
        if rule.join_id in self._rules:
            return self.record_outcome(rule.join_id, True) if seen_rows else self._rules[rule.join_id]
        return self.save(rule)
