"""Specs of federated queries: parsing, validation, plans."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators.merge import Pair


class SpecError(ValueError):
    """A spec that can't be read or that names what isn't there."""


@dataclass(frozen=True)
class SubQuery:
    db: str
    query: str | dict
    key: str


@dataclass
class FederatedPlan:
    sub_queries: list[SubQuery]
    pairs: list[Pair] = field(default_factory=list)
    transforms: list[dict] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    strategy: str = "federated"
    frames: dict = field(default_factory=dict)

    def provenance(self) -> dict:
        return {
            "strategy": self.strategy,
            "databases": list(dict.fromkeys(s.db for s in self.sub_queries)),
            "join_rules_applied": self.rules,
            "db_key_map": {s.key: s.db for s in self.sub_queries},
            "merge_on": [[f"{p.left_key}.{p.left_column}", f"{p.right_key}.{p.right_column}"] for p in self.pairs],
            "sub_queries": [{"db": s.db, "query": s.query, "key": s.key} for s in self.sub_queries],
        }


def _decoded(x: object) -> object:
    """Sub-queries may be JSON in text, alone or in a list of one."""
    while isinstance(x, str) or (isinstance(x, list) and len(x) == 1 and isinstance(x[0], str)):
        text = x if isinstance(x, str) else x[0]
        try:
            x, _ = json.JSONDecoder().raw_decode(text.strip())
        except json.JSONDecodeError as e:
            raise SpecError(f"sub_queries can't be read: {e}") from e
    return x


def parse(query: str | dict, databases: list[str], document_sources: tuple[str, ...] = ()) -> FederatedPlan:
    """A plan from one SQL statement, a document pipeline or a spec; ``databases`` are the sources it may use."""
    spec = query
    if isinstance(query, str):
        text = query.strip()
        if text[:1] not in ("{", "["):
            if not databases:
                raise SpecError("no database")
            return FederatedPlan([SubQuery(databases[0], query, "result")], strategy="single_database")
        try:
            spec = json.loads(text)
        except json.JSONDecodeError as e:
            raise SpecError(f"the spec can't be read: {e}") from e
    if not isinstance(spec, dict):
        raise SpecError("a spec is an object")
    transforms = spec.get("transform") or spec.get("transforms") or []
    if "collection" in spec:
        db = spec.get("db") or next((d for d in databases if d in document_sources), databases[0] if databases else None)
        if db is None:
            raise SpecError("no source for documents")
        return FederatedPlan([SubQuery(db, {"collection": spec["collection"], "pipeline": spec.get("pipeline", [])}, "result")], transforms=transforms, strategy="single_database")
    found = _decoded(spec.get("sub_queries"))
    found = [found] if isinstance(found, dict) else found
    if not found:
        raise SpecError("a spec needs sub_queries")
    subs = []
    for i, s in enumerate(found):
        if not isinstance(s, dict) or "query" not in s:
            raise SpecError(f"sub-query {i} needs a query")
        db = s.get("db") or (databases[0] if databases else None)
        if databases and db not in databases:
            raise SpecError(f"unknown database {db!r}")
        subs.append(SubQuery(db, s["query"], s.get("key") or f"q{i}"))
    names = [s.key for s in subs]
    if len(set(names)) < len(names):
        raise SpecError("two sub-queries have one key")
    pairs = []
    for pair in spec.get("join_on") or []:
        if len(pair) not in (2, 3):
            raise SpecError(f"a pair of join_on has two sides: {pair!r}")
        p = Pair.parse(*pair)
        for key in (p.left_key, p.right_key):
            if key not in names:
                raise SpecError(f"join_on names an unknown key {key!r}")
        pairs.append(p)
    return FederatedPlan(subs, pairs, transforms)
