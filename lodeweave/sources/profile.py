"""Table metadata: schemas, statistics, hashes, differences, and a cache of them with a lifetime."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from .catalog import SourceCatalog

# Name parts of columns that hold free text.
FREE_TEXT = frozenset("description desc bio biography text body content note notes comment comments summary detail details narrative abstract overview message info information remark remarks review reviews feedback".split())


def is_unstructured(name: str, kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType)) and any(p in FREE_TEXT for p in re.split(r"[_-]", name.lower()))


@dataclass
class Column:
    name: str
    dtype: str
    nullable: bool = True
    is_unstructured: bool = False
    unique_rate: float | None = None
    null_rate: float | None = None
    p50: float | None = None
    p95: float | None = None


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    row_count: int | None = None
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)

    def hash(self) -> str:
        shape = {c.name: {"dtype": c.dtype, "nullable": c.nullable} for c in self.columns}
        return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()[:16]


def columns_of(df: DataFrame) -> list[Column]:
    return [Column(f.name, f.dataType.simpleString(), f.nullable, is_unstructured(f.name, f.dataType)) for f in df.schema.fields]


def statistics(df: DataFrame) -> DataFrame:
    """One row: row count, and for each column null rate, approximate distinct rate and, of numbers, median and 95th percentile. One pass."""
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        parts.append(F.avg(c.isNull().cast("double")).alias(f"null_{i}"))
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.try_divide(F.approx_count_distinct(c), F.count(c)).alias(f"unique_{i}"))
        if isinstance(f.dataType, T.NumericType):
            parts.append(F.percentile_approx(c.cast("double"), [0.5, 0.95], 10_000).alias(f"p_{i}"))
    return df.agg(*parts)


def profile(df: DataFrame, name: str) -> Table:
    row = statistics(df).first().asDict()
    out = Table(name, columns_of(df), row["rows"])
    for i, c in enumerate(out.columns):
        c.null_rate = row[f"null_{i}"]
        rate = row.get(f"unique_{i}")
        c.unique_rate = None if rate is None else min(1.0, rate)
        if row.get(f"p_{i}"):
            c.p50, c.p95 = row[f"p_{i}"]
    return out


def profile_rows(df: DataFrame) -> DataFrame:
    """The profile as rows: ``column, null_rate, non_null, low, high`` with exact numbers."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        parts += [F.count_if(c.isNull()).alias(f"n{i}"), F.count(c).alias(f"m{i}"), F.count_distinct(c).alias(f"d{i}")]
    one = df.agg(F.count("*").alias("rows"), *parts)
    rows = F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"m{i}").alias("non_null"), F.col(f"d{i}").alias("distinct_values")) for i, f in enumerate(df.schema.fields))))
    return one.select(rows.alias("x")).select("x.*")


class SchemaCache:
    """Tables of each source as JSON under ``path``, with a lifetime; saving replaces all of a source."""

    def __init__(self, path: str, ttl_seconds: float = 24 * 3600):
        self.path, self.ttl = path, ttl_seconds
        os.makedirs(path, exist_ok=True)

    def _file(self, alias: str) -> str:
        return os.path.join(self.path, f"{hashlib.sha256(alias.encode()).hexdigest()[:16]}.json")

    def save(self, alias: str, tables: dict[str, Table]) -> None:
        whole = {"alias": alias, "at": time.time(), "tables": {n: asdict(t) for n, t in tables.items()}}
        with open(self._file(alias) + ".new", "w") as f:
            json.dump(whole, f)
        os.replace(self._file(alias) + ".new", self._file(alias))

    def _stored(self, alias: str) -> tuple[float, dict[str, Table]] | None:
        try:
            with open(self._file(alias)) as f:
                whole = json.load(f)
        except FileNotFoundError:
            return None
        return whole["at"], {n: Table(t["name"], [Column(**c) for c in t["columns"]], t["row_count"], [tuple(k) for k in t["foreign_keys"]]) for n, t in whole["tables"].items()}

    def load(self, alias: str) -> dict[str, Table] | None:
        found = self._stored(alias)
        return found[1] if found and found[0] > time.time() - self.ttl and found[1] else None

    def invalidate(self, alias: str) -> None:
        if os.path.exists(self._file(alias)):
            os.remove(self._file(alias))

    def get_hash(self, alias: str, table: str) -> str | None:
        found = self._stored(alias)
        return found[1][table].hash() if found and table in found[1] else None


class SchemaScanner:
    def __init__(self, catalog: SourceCatalog, cache: SchemaCache):
        self.catalog, self.cache = catalog, cache

    def introspect(self, alias: str, profiled: bool = False) -> dict[str, Table]:
        out = {}
        for name in self.catalog.tables(alias):
            df = self.catalog.table(alias, name)
            table = profile(df, name) if profiled else Table(name, columns_of(df), df.count())
            table.foreign_keys = [k[1:] for k in self.catalog.source(alias).foreign_keys if k[0] == name]
            out[name] = table
        return out

    def scan(self, alias: str, force: bool = False, profiled: bool = False) -> dict[str, Table]:
        if not force and (known := self.cache.load(alias)):
            return known
        found = self.introspect(alias, profiled)
        self.cache.save(alias, found)
        return found

    def scan_all(self, force: bool = False) -> dict[str, dict[str, Table]]:
        """A source that can't be read has no tables."""
        out = {}
        for alias in self.catalog.sources:
            try:
                out[alias] = self.scan(alias, force)
            except Exception:
                out[alias] = {}
        return out

    def diff(self, alias: str) -> list[str]:
        """Tables that are new, changed or dropped since the cached scan."""
        stored = self.cache._stored(alias)
        known = stored[1] if stored else {}
        fresh = {n: Table(n, columns_of(self.catalog.table(alias, n))) for n in self.catalog.tables(alias)}
        return sorted({n for n, t in fresh.items() if n not in known or known[n].hash() != t.hash()} | (known.keys() - fresh.keys()))
