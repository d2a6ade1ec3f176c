"""Checks on the parsed plan: read-only statements, limits, cost, repeats, time."""

from __future__ import annotations

import json
import re
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.docpipe import WRITES


class SafetyViolation(ValueError):
    """``kind`` is PARSE_ERROR, MULTIPLE_STATEMENTS, WRITE_OPERATION, DDL_OPERATION or UNKNOWN_TABLE."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


_WRITE = re.compile(r"Insert|Delete|Update|Merge|Overwrite|Append|^SaveInto")
_DDL = re.compile(r"Create|Drop|Alter|Add|Rename|Replace|Truncate|Set(?!Operation)|Cache|Uncache|Refresh|Analyze|Load|Repair|Compound|Command|Declare|Comment|Msck|Recover")
_READS = frozenset("""Project Filter Join Aggregate Sort Distinct Deduplicate Union Intersect Except GlobalLimit LocalLimit Offset
    SubqueryAlias UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedWith CTERelationDef WithCTE Window
    Generate Expand Pivot Unpivot Repartition RepartitionByExpression Sample UnresolvedSubqueryColumnAliases UnresolvedHint ResolvedHint
    LateralJoin UnresolvedTableValuedFunction UnresolvedHaving Range WithWindowDefinition UnresolvedCTERelationDef UnionLoop View
    ResolvedInlineTable Tail UnresolvedTVFAliases AsOfJoin NaturalJoin UsingJoin RebalancePartitions""".split())
_CALLS = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.I)


def _parse(spark: SparkSession, query: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)


#: Expressions that hold a plan.
_PLANS = frozenset("ScalarSubquery Exists ListQuery LateralSubquery FunctionTableSubqueryArgumentExpression".split())


def _subqueries(node) -> list:
    """Plans within a node's expressions."""
    out, stack = [], []
    inner = node.expressions()
    stack += [inner.apply(i) for i in range(inner.size())]
    while stack:
        e = stack.pop()
        if e.getClass().getSimpleName() in _PLANS:
            out.append(e.plan())
        below = e.children()
        stack += [below.apply(i) for i in range(below.size())]
    return out


def _nodes(plan, expressions: bool = False):
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        if expressions:
            stack += _subqueries(node)
        for part in ("children", "innerChildren"):
            inner = getattr(node, part)()
            for i in range(inner.size()):
                child = inner.apply(i)
                if hasattr(child, "innerChildren") and hasattr(child, "nodeName"):
                    stack.append(child)


def _relations(plan) -> tuple[list[list[str]], set[str]]:
    """Names of the relations that a parsed plan reads, in parts, and of its common table expressions."""
    read, own = [], set()
    for node in _nodes(plan, expressions=True):
        name = node.nodeName().strip("'")
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            read.append([parts.apply(i) for i in range(parts.size())])
        elif name == "UnresolvedWith":
            ctes = node.cteRelations()
            own |= {ctes.apply(i)._1().lower() for i in range(ctes.size())}
    return read, own


def check(spark: SparkSession, query: str, known: list[str] | None = None) -> None:
    """Raises unless ``query`` only reads, and of tables only those that are ``known``; document pipelines pass unless a stage writes.

    Without ``known`` every table of one name passes; files by path and other catalogs never do.
    """
    text = query.strip()
    if not text:
        return
    if text[0] in "{[":
        try:
            if any(f'"{w}"' in json.dumps(json.loads(text)) for w in WRITES):
                raise SafetyViolation("WRITE_OPERATION", "a pipeline stage writes")
        except json.JSONDecodeError as e:
            raise SafetyViolation("PARSE_ERROR", str(e)) from e
        return
    try:
        plan = _parse(spark, text.rstrip().rstrip(";"))
    except Exception as e:
        bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", "", text, flags=re.S).rstrip().rstrip(";")
        if ";" in bare:
            raise SafetyViolation("MULTIPLE_STATEMENTS", "one statement at a time") from e
        raise SafetyViolation("PARSE_ERROR", str(e).splitlines()[0]) from e
    for node in _nodes(plan, expressions=True):
        name = node.nodeName().strip("'")
        if name in _READS:
            continue
        if _WRITE.search(name):
            raise SafetyViolation("WRITE_OPERATION", name)
        raise SafetyViolation("DDL_OPERATION" if _DDL.search(name) else "WRITE_OPERATION" if "Into" in name else "DDL_OPERATION", name)
    read, own = _relations(plan)
    for parts in read:
        if len(parts) > 1 or (known is not None and parts[0].lower() not in own | {k.lower() for k in known}):
            raise SafetyViolation("UNKNOWN_TABLE", ".".join(parts))
    if _CALLS.search(text):
        raise SafetyViolation("DDL_OPERATION", "calls of JVM methods aren't allowed")


def is_safe(spark: SparkSession, query: str) -> bool:
    try:
        check(spark, query)
    except SafetyViolation:
        return False
    return True


def is_aggregate(df: DataFrame) -> bool:
    """Whether the result is an aggregate, projected, filtered or sorted at most; all of its groups are kept. A window keeps every row of its input, so it is none."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "Sort", "SubqueryAlias", "View", "WithCTE"):
        below = node.children()
        node = below.apply(below.size() - 1)
    return node.nodeName() == "Aggregate"


def has_limit(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().nodeName() == "GlobalLimit"


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """``df`` with a limit, unless it has one or is an aggregate."""
    return df if limit is None or has_limit(df) or is_aggregate(df) else df.limit(limit)


_LIMIT = re.compile(r"\s+limit\s+\d+\s*;?\s*$", re.I)


def push_aggregation(spark: SparkSession, query: str, honor_limit: bool = False) -> str:
    """A grouped query without an order loses its limit: which groups it would keep is arbitrary."""
    if honor_limit or not _LIMIT.search(query):
        return query
    bare = _LIMIT.sub("", query)
    names = [n.nodeName().strip("'") for n in _nodes(_parse(spark, bare))]
    return bare if names and names[0] == "Aggregate" else query


def tables(df: DataFrame) -> list[str]:
    """Names of the tables that the plan reads."""
    found = []
    for n in _nodes(df._jdf.queryExecution().analyzed(), expressions=True):
        if n.nodeName() == "SubqueryAlias":
            name = n.identifier().name()
            if name not in found:
                found.append(name)
    return found


def origin(df: DataFrame, column: str) -> tuple[str, str] | None:
    """Table and column that a result's column is taken from as it is, by whatever name; None where it is computed."""
    plan = df._jdf.queryExecution().analyzed()
    at = next((i for i, c in enumerate(df.columns) if c == column), None)
    if at is None:
        return None
    wanted = plan.output().apply(at).exprId().id()
    nodes = list(_nodes(plan))
    sources = {}  # what an alias stands for
    for n in nodes:
        if n.nodeName() in ("Project", "Aggregate"):
            named = n.projectList() if n.nodeName() == "Project" else n.aggregateExpressions()
            for i in range(named.size()):
                e = named.apply(i)
                if e.nodeName() == "Alias":
                    sources[e.exprId().id()] = e.child()
    while wanted in sources:
        if sources[wanted].nodeName() != "AttributeReference":
            return None
        wanted = sources[wanted].exprId().id()
    for n in nodes:
        if n.nodeName() == "SubqueryAlias":
            held = n.output()
            for i in range(held.size()):
                if held.apply(i).exprId().id() == wanted:
                    return n.identifier().name(), held.apply(i).name()
    return None


def cost(df: DataFrame) -> float:
    """Bytes that the optimizer expects; comparable between plans, not between sources."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass
class Repeats:
    """Queries already asked in each session."""

    seen: dict[str, set] = field(default_factory=dict)

    def add(self, session: str, query: str, databases: list[str]) -> bool:
        """False if the session has asked this before."""
        key = (" ".join(query.lower().split()), tuple(sorted(databases)))
        known = self.seen.setdefault(session, set())
        new = key not in known
        known.add(key)
        return new

    def reset(self, session: str) -> None:
        self.seen.pop(session, None)


class QueryTimeout(RuntimeError):
    pass


def within(spark: SparkSession, seconds: float | None, tag: str, action):
    """``action()``; its Spark jobs are cancelled after ``seconds``."""
    if not seconds:
        return action()
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise QueryTimeout(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
