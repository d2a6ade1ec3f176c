"""Plausibility of results, and the warnings that go with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .sources.profile import Table

LARGE_TABLE, TOLERANCE, CHECKED_ROWS = 1_000, 3.0, 100


@dataclass
class Plausibility:
    score: float
    failure_mode: str | None = None
    warnings: list[str] = field(default_factory=list)
    details: dict = field(default_factory=dict)

    @property
    def plausible(self) -> bool:
        return self.score >= 0.5


def plausibility(rows: list[dict], query: str, schema: dict[str, dict[str, Table]], large: int = LARGE_TABLE, tolerance: float = TOLERANCE) -> Plausibility:
    """No rows are odd if the query names a large table; numbers far beyond a column's 95th percentile are odd."""
    every = [t for tables in schema.values() for t in tables.values()]
    if not rows:
        named = [t.name for t in every if (t.row_count or 0) >= large and t.name.lower() in query.lower()]
        if named:
            return Plausibility(0.2, "wrong_join_key", [f"no rows, though {', '.join(named)} has at least {large} rows"], {"tables": named})
        return Plausibility(0.6, "empty_result", ["no rows"])
    high: dict[str, float] = {}
    for t in every:
        for c in t.columns:
            if c.p95 is not None:
                high[c.name] = max(high.get(c.name, c.p95), c.p95)
    warnings = []
    for row in rows[:CHECKED_ROWS]:
        for name, v in row.items():
            if name in high and isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) > tolerance * high[name]:
                warnings.append(f"{name} = {v} is beyond {tolerance} times the 95th percentile {high[name]}")
    if warnings:
        return Plausibility(1 - min(0.5, 0.1 * len(warnings)), "schema_mismatch", warnings)
    return Plausibility(1.0)


def truncation_warnings(truncated: bool, limit: int | None, grouped: bool, shown: int, count: int) -> list[str]:
    out = []
    if truncated:
        out.append(f"the result was cut at {limit} rows; aggregate or filter in the query")
        if grouped:
            out.append("a grouped query was cut: groups are missing")
    if count > 5000:
        out.append(f"{count} rows; transforms or aggregates would serve better than reading them")
    elif count > shown:
        out.append(f"{shown} of {count} rows are shown")
    return out
