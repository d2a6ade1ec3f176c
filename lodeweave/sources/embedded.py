"""Python data sources over embedded database files: SQLite and DuckDB.

A read is cut into partitions by ranges of the row id; equality and comparison
filters go into the database's own query. Files must be reachable where the
executors run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _spark_type(kind: str) -> str:
    k = kind.upper()
    if "BOOL" in k:
        return "boolean"
    if "INT" in k:
        return "bigint"
    if any(x in k for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    if "BLOB" in k:
        return "binary"
    return "string"


@dataclass
class RowRange(InputPartition):
    first: int | None
    stop: int | None


class _Reader(DataSourceReader):
    _signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, source: _Embedded, schema):
        self.source, self.schema, self.filters = source, schema, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            sign = self._signs.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.filters.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n, wanted = self.source.bounds(), int(self.source.options.get("partitions", 4))
        if n is None or wanted < 2:
            return [RowRange(None, None)]
        low, high = n
        step = -(-(high - low + 1) // wanted)
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)] or [RowRange(None, None)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        tests, values = [], []
        if partition.first is not None:
            tests.append("rowid >= ? and rowid < ?")
            values += [partition.first, partition.stop]
        for column, sign, value in self.filters:
            tests.append(f"{_name(column)} {sign} ?")
            values.append(value)
        where = f" where {' and '.join(tests)}" if tests else ""
        names = self.schema.fieldNames()
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        convert = {"string": str, "double": float, "long": int, "boolean": bool}
        with self.source.connection() as c:
            cursor = c.execute(f"select {', '.join(map(_name, names))} from {self.source.relation()}{where}", values)
            while rows := cursor.fetchmany(2000):
                for row in rows:
                    yield tuple(v if v is None or k not in convert else convert[k](v) for v, k in zip(row, kinds, strict=True))


class _Embedded(DataSource):
    def reader(self, schema):
        return _Reader(self, schema)

    def relation(self) -> str:
        if "query" in self.options:
            return f"({self.options['query']})"
        return _name(self.options["table"])


class SqliteSource(_Embedded):
    """``spark.read.format("lodeweave_sqlite").option("path", …).option("table", …)`` (or ``query``)."""

    @classmethod
    def name(cls) -> str:
        return "lodeweave_sqlite"

    def connection(self):
        import contextlib
        import sqlite3

        return contextlib.closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True))

    def schema(self) -> str:
        with self.connection() as c:
            if "query" in self.options:
                cursor = c.execute(f"select * from {self.relation()} limit 200")
                rows = cursor.fetchall()
                kinds = []
                for i, d in enumerate(cursor.description):
                    seen = {type(r[i]) for r in rows} - {type(None)}
                    kinds.append((d[0], "bigint" if seen == {int} else "double" if seen and seen <= {int, float} else "binary" if seen == {bytes} else "string"))
            else:
                kinds = [(r[1], _spark_type(r[2])) for r in c.execute(f"pragma table_info({_name(self.options['table'])})")]
        return ", ".join(f"`{n}` {k}" for n, k in kinds)

    def bounds(self):
        if "query" in self.options:
            return None
        with self.connection() as c:
            try:
                low, high = c.execute(f"select min(rowid), max(rowid) from {self.relation()}").fetchone()
            except sqlite_error():
                return None  # a view, or a table without row ids
        return None if low is None else (low, high)


def sqlite_error():
    import sqlite3

    return sqlite3.OperationalError


class DuckdbSource(_Embedded):
    """``spark.read.format("lodeweave_duckdb").option("path", …).option("table", …)`` (or ``query``)."""

    @classmethod
    def name(cls) -> str:
        return "lodeweave_duckdb"

    def connection(self):
        import duckdb

        return duckdb.connect(self.options["path"], read_only=True)

    def schema(self) -> str:
        with self.connection() as c:
            rows = c.execute(f"describe select * from {self.relation()}").fetchall()
        return ", ".join(f"`{r[0]}` {_spark_type(r[1])}" for r in rows)

    def bounds(self):
        if "query" in self.options:
            return None
        with self.connection() as c:
            try:
                low, high = c.execute(f"select min(rowid), max(rowid) from {self.relation()}").fetchone()
            except Exception:  # a view has no row ids
                return None
        return None if low is None else (low, high)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(DuckdbSource)
