"""The engine: queries over registered sources, their schemas, joins, plans, checks and log."""

from __future__ import annotations

import datetime
import decimal
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import AuditLog
from .functions import sql as sql_functions
from .functions.text import quoted
from .operators import stats, transforms
from .operators.docpipe import PipelineError
from .operators.merge import MergeError, Pair, merge
from .plans import guard, spec
from .plans.discovery import JoinDiscovery, detect_join
from .plans.registry import JoinRegistry, JoinRule
from .sources.catalog import SourceCatalog, SourceError
from .sources.profile import SchemaCache, SchemaScanner, Table
from .verify import Plausibility, plausibility, truncation_warnings

SHOWN = 100


@dataclass
class Config:
    """Fields can come from the environment: ``LODEWEAVE_`` and the name in capitals."""

    database_uris: tuple[str, ...] = ()
    schema_cache_path: str = "~/.lodeweave/schema"
    schema_ttl_hours: float = 24
    join_rules_path: str = "~/.lodeweave/joins"
    audit_log_path: str = "~/.lodeweave/audit"
    default_row_limit: int | None = 10_000
    max_cost_bytes: float | None = None
    hidden_tables: tuple[str, ...] = ()
    name_similarity_threshold: float = 0.70
    value_sample_size: int = 50
    overlap_threshold: float = 0.70
    min_confidence_to_propose: float = 0.60
    zero_row_warning_threshold: int = 1_000
    numeric_range_tolerance: float = 3.0
    timeout_seconds: float | None = 180

    @classmethod
    def from_environment(cls) -> Config:
        out = cls()
        for name, default in asdict(out).items():
            raw = os.environ.get(f"LODEWEAVE_{name.upper()}")
            if raw is not None:
                kind = tuple if isinstance(default, (tuple, list)) else int if isinstance(default, int) else float if isinstance(default, float) or default is None else str
                setattr(out, name, tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw))
        return out


@dataclass
class Result:
    """``df`` is lazy; ``rows`` are its first ``SHOWN``."""

    df: DataFrame | None
    rows: list[dict] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)
    provenance: dict = field(default_factory=dict)
    plausibility: Plausibility | None = None
    execution_ms: float = 0.0
    error: str | None = None
    error_type: str | None = None

    def envelope(self) -> dict:
        if self.error:
            return {"error": self.error, **({"error_type": self.error_type} if self.error_type else {})}
        out = {"row_count": self.row_count, "columns": self.columns, "rows": [{k: plain(v) for k, v in r.items()} for r in self.rows], "truncated": self.truncated, "execution_ms": self.execution_ms, "provenance": self.provenance}
        if self.warnings:
            out["warnings"] = self.warnings
        if self.plausibility:
            out["plausibility"] = {"score": self.plausibility.score, "failure_mode": self.plausibility.failure_mode}
        return out


def plain(v: object) -> object:
    """A value that JSON can hold."""
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v.asDict(True) if hasattr(v, "asDict") else v


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config.from_environment()
        c = self.config
        place = lambda p: os.path.expanduser(p)
        self.catalog = SourceCatalog(spark, tuple(c.hidden_tables))
        self.catalog.from_uris(list(c.database_uris))
        self.scanner = SchemaScanner(self.catalog, SchemaCache(place(c.schema_cache_path), c.schema_ttl_hours * 3600))
        self.registry = JoinRegistry(spark, place(c.join_rules_path))
        self.log = AuditLog(spark, place(c.audit_log_path))
        self.repeats = guard.Repeats()
        sql_functions.register(spark)

    # -- building -------------------------------------------------------------

    def _parse(self, query: str | dict, databases: list[str] | None) -> spec.FederatedPlan:
        names = databases or list(self.catalog.sources)
        for n in names:
            self.catalog.source(n)
        documents = tuple(a for a, s in self.catalog.sources.items() if s.kind in ("documents", "mongodb"))
        return spec.parse(query, names, documents)

    def _frames(self, plan: spec.FederatedPlan, honor_limit: bool) -> dict[str, DataFrame]:
        out = {}
        for s in plan.sub_queries:
            text = s.query
            if isinstance(text, str) and text.strip()[:1] == "{":
                text = json.loads(text)
            if isinstance(text, str):
                guard.check(self.spark, text, self.catalog.tables(s.db))
                text = guard.push_aggregation(self.spark, text, honor_limit)
            else:
                guard.check(self.spark, json.dumps(text))
            out[s.key] = self.catalog.query(s.db, text)
        return out

    def _rules(self, plan: spec.FederatedPlan, frames: dict[str, DataFrame]) -> list[Pair]:
        """Without a join in the spec, the best reliable rule between neighbouring sub-queries."""
        pairs = []
        for a, b in zip(plan.sub_queries, plan.sub_queries[1:], strict=False):
            found = [r for ta in guard.tables(frames[a.key]) for tb in guard.tables(frames[b.key]) for r in self.registry.find_for_tables(a.db, ta, b.db, tb) if r.is_reliable and r.column_a in frames[a.key].columns and r.column_b in frames[b.key].columns]
            if found:
                best = max(found, key=lambda r: r.confidence)
                plan.rules.append(best.join_id)
                pairs.append(Pair(a.key, best.column_a, b.key, best.column_b, best.transform))
        return pairs

    def _detected(self, plan: spec.FederatedPlan, frames: dict[str, DataFrame]) -> list[Pair]:
        """Without a join in the spec and without a rule, the columns of neighbouring results that join best, fields of objects in text included."""
        pairs = []
        for a, b in zip(plan.sub_queries, plan.sub_queries[1:], strict=False):
            m = detect_join(frames[a.key], frames[b.key])
            if m is None:
                continue
            if m.column_b not in frames[b.key].columns:
                parent, _, name = m.column_b.partition("__")
                frames[b.key] = frames[b.key].withColumn(m.column_b, F.get_json_object(F.col(quoted(parent)), f"$.{name}"))
            pairs.append(Pair(a.key, m.column_a, b.key, m.column_b, m.transform, both=True))
        return pairs

    def _learn(self, plan: spec.FederatedPlan, count: int) -> None:
        """Joins that a spec spelled out become unconfirmed rules, or reinforce known ones."""
        of = {s.key: s for s in plan.sub_queries}
        for p in plan.pairs if not plan.rules else []:
            ends = []
            for key, name in ((p.left_key, p.left_column), (p.right_key, p.right_column)):
                frame, text = plan.frames[key], of[key].query
                table = text.get("collection") if isinstance(text, dict) else next(iter(guard.tables(frame)), "unknown")
                ends += [of[key].db, *(guard.origin(frame, name) or (table, name))]
            self.registry.propose(tuple(ends), p.transform, count > 0)

    def verify_rules(self) -> list[dict]:
        """Every rule measured again; those between two tables are replaced by what was found."""
        c = self.config
        finder = JoinDiscovery(self.catalog, c.name_similarity_threshold, c.overlap_threshold, c.min_confidence_to_propose, c.value_sample_size)
        fresh: dict[tuple, list[JoinRule]] = {}
        for rule, score, transform in finder.verify(self.registry.get_all()):
            ends = (rule.db_a, rule.table_a, rule.db_b, rule.table_b)
            fresh.setdefault(ends, []).append(replace(rule, confidence=score, transform=transform or rule.transform, confirmed=rule.confirmed and score >= c.min_confidence_to_propose))
        for ends, rules in fresh.items():
            self.registry.replace_for_tables(*ends, rules)
        return [asdict(r) for r in self.registry.get_all()]

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.catalog.close()

    def frame(self, query: str | dict, databases: list[str] | None = None, honor_limit: bool = False, strict: bool = True, detect: bool = False, **merge_options: str) -> tuple[DataFrame, spec.FederatedPlan]:
        """The lazy result of a query, and its plan; errors are raised."""
        plan = self._parse(query, databases)
        frames = self._frames(plan, honor_limit)
        if len(frames) > 1 and not plan.pairs:
            plan.pairs = self._rules(plan, frames)
            if not plan.pairs and detect:
                plan.pairs = self._detected(plan, frames)
        plan.frames = frames
        df = merge(frames, plan.pairs, **merge_options)
        return transforms.apply(df, plan.transforms, strict), plan

    # -- public ---------------------------------------------------------------

    def query(self, query: str | dict, databases: list[str] | None = None, session_id: str | None = None, row_limit: int | None = None, honor_limit: bool = False, strict: bool = True, detect: bool = False, **merge_options: str) -> Result:
        """Errors are in the result: planning_error, cost_overrun, timeout, safety_violation or execution_error."""
        began = time.time()
        text = query if isinstance(query, str) else json.dumps(query)
        if session_id and not self.repeats.add(session_id, text, databases or []):
            return Result(None, error="this session has asked this before")
        try:
            df, plan = self.frame(query, databases, honor_limit, strict, detect, **merge_options)
        except guard.SafetyViolation as e:
            return Result(None, error=str(e), error_type="safety_violation")
        except (spec.SpecError, MergeError, SourceError, PipelineError, transforms.UnknownOperator) as e:
            return Result(None, error=str(e), error_type="planning_error")
        except Exception as e:
            return Result(None, error=str(e).splitlines()[0], error_type="execution_error")
        try:
            bytes_expected = guard.cost(df)
            if self.config.max_cost_bytes is not None and bytes_expected > self.config.max_cost_bytes:
                return Result(None, error=f"{bytes_expected:.0f} bytes expected; the budget is {self.config.max_cost_bytes:.0f}", error_type="cost_overrun")
            limit = row_limit if row_limit is not None else self.config.default_row_limit
            whole = guard.is_aggregate(df) or limit is None
            capped = df if whole else df.limit(limit + 1)

            def fetch() -> tuple[int, list]:
                kept = capped.persist()
                try:
                    return kept.count(), kept.limit(SHOWN).collect()
                finally:
                    kept.unpersist()

            count, rows = guard.within(self.spark, self.config.timeout_seconds, f"lodeweave-{uuid.uuid4().hex}", fetch)
        except guard.QueryTimeout as e:
            return Result(None, error=str(e), error_type="timeout")
        except Exception as e:
            return Result(None, error=str(e).splitlines()[0], error_type="execution_error")
        truncated = not whole and count > limit
        count = min(count, limit) if truncated else count
        found = [r.asDict(True) for r in rows[:count]]
        schema = {a: t for a in plan.provenance()["databases"] if (t := self.scanner.cache.load(a))}
        score = plausibility(found, text, schema, self.config.zero_row_warning_threshold, self.config.numeric_range_tolerance)
        warnings = score.warnings + truncation_warnings(truncated, limit, "group by" in text.lower(), SHOWN, count)
        if len(plan.sub_queries) > 1 and not plan.pairs:
            warnings.append(f"no join is known: only {plan.sub_queries[0].key} is returned, not {', '.join(s.key for s in plan.sub_queries[1:])}")
        self.registry.observe(plan.rules, count)
        self._learn(plan, count)
        took = (time.time() - began) * 1000
        self.log.record(session_id or uuid.uuid4().hex, text, plan.provenance()["databases"], count, took, score.score, warnings, truncated, bytes_expected)
        return Result(df if whole else df.limit(limit), found, df.columns, count, truncated, warnings, plan.provenance(), score, took)

    def schema(self, database: str | None = None, table: str | None = None, force_refresh: bool = False, profiled: bool = False) -> dict:
        if database is None:
            return {a: {n: {"columns": len(t.columns), "row_count": t.row_count} for n, t in tables.items()} for a, tables in self.scanner.scan_all(force_refresh).items()}
        found = self.scanner.scan(database, force_refresh, profiled)
        if table is None:
            return {n: asdict(t) for n, t in found.items()}
        if table not in found:
            raise SourceError(f"no table {table!r} in {database!r}")
        return asdict(found[table])

    def joins(self, discover: bool = False, confirm: str | None = None, reject: str | None = None, suggest=None) -> list[dict] | bool:
        if confirm:
            return self.registry.confirm(confirm)
        if reject:
            return self.registry.reject(reject)
        if discover:
            c = self.config
            finder = JoinDiscovery(self.catalog, c.name_similarity_threshold, c.overlap_threshold, c.min_confidence_to_propose, c.value_sample_size)
            for x in finder.discover(self.scanner.scan_all(), suggest):
                self.registry.save_if_new(JoinRule(*x.a, *x.b, transform=x.transform, confidence=x.confidence))
        return [asdict(r) for r in self.registry.get_all()]

    def plan(self, query: str | dict, databases: list[str] | None = None) -> dict:
        plan = self._parse(query, databases)
        out = plan.provenance()
        costs = {}
        for s in plan.sub_queries:
            try:
                costs[s.key] = guard.cost(self.catalog.query(s.db, s.query))
            except Exception:
                costs[s.key] = -1.0
        df, plan = self.frame(query, databases)
        return out | {"costs": costs, "join_rules_applied": plan.rules, "explain": df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))}

    def verify(self, rows: list[dict] | DataFrame, query: str = "") -> Plausibility:
        found = [r.asDict(True) for r in rows.limit(SHOWN).collect()] if isinstance(rows, DataFrame) else rows
        return plausibility(found, query, {a: t for a in self.catalog.sources if (t := self.scanner.cache.load(a))})

    def audit(self, session_id: str | None = None, recent: int = 20, replay_id: int | None = None) -> list[dict] | dict | None:
        if replay_id is not None:
            return self.log.replay(replay_id)
        return self.log.get_session(session_id) if session_id else self.log.recent(recent)

    def connections(self) -> list[dict]:
        return self.catalog.connections()

    def reset_session(self, session_id: str) -> None:
        self.repeats.reset(session_id)

    def math_compute(self, query: str | dict | None = None, rows: list[dict] | DataFrame | None = None, operation: str | None = None, expression: str | dict[str, str] | None = None, databases: list[str] | None = None, **options) -> list[dict]:
        """``chi_square``, ``ema`` or aggregate SQL expressions over the whole result of a query, or over rows."""
        if rows is not None:
            df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows)
        else:
            df, _ = self.frame(query, databases)
        if expression:
            df = stats.expression(df, **(expression if isinstance(expression, dict) else {"result": expression}))
        elif operation == "chi_square":
            found = [r.asDict(True) for r in stats.chi_square(df, **options).collect()]
            if not found[0]["grand_total"]:
                raise ValueError("the total of the table is zero")
            return found
        elif operation == "ema":
            df = stats.ema(df, **options)
        else:
            raise ValueError("an operation or an expression is needed")
        return [r.asDict(True) for r in df.collect()]

    def context(self, alias: str, samples: int = 1) -> str:
        """Tables and columns of a source as text, ``*`` at free text, with foreign keys, sample rows and join rules."""
        found: dict[str, Table] = self.scanner.scan(alias)
        short = len(found) > 30
        lines = []
        for t in found.values():
            names = ", ".join(f"{c.name}{'*' if c.is_unstructured else ''}" + ("" if short else f" {c.dtype}") for c in t.columns)
            lines.append(f"{alias}.{t.name}({names})" + ("" if t.row_count is None else f" -- {t.row_count} rows"))
            lines += [f"  {c} -> {rt}.{rc}" for c, rt, rc in t.foreign_keys]
            if not short and samples:
                lines += [f"  {json.dumps({k: plain(v) for k, v in r.asDict(True).items()}, default=str)[:300]}" for r in self.catalog.table(alias, t.name).limit(samples).collect()]
        for r in self.registry.get_all():
            identity = r.transform in (None, "identity")
            if alias in (r.db_a, r.db_b) and (r.confirmed or (identity and r.column_a == r.column_b and r.confidence >= 0.85) or (not identity and r.confidence >= 0.80)):
                lines.append(f"join {r.db_a}.{r.table_a}.{r.column_a} = {r.db_b}.{r.table_b}.{r.column_b} by {r.transform or 'identity'}")
        return "\n".join(lines)
