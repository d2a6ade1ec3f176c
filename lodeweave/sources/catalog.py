"""Sources by alias: files, JDBC, embedded databases and document collections, read lazily as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators import docpipe
from . import embedded

FILES = ("parquet", "json", "csv", "orc")
#: Options that cut a JDBC table into ranges, which a query of one row can't have.
_CUT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


class SourceError(ValueError):
    """A source, a table or a scheme that isn't known."""


@dataclass
class Source:
    """``kind``: a file format, ``jdbc``, ``sqlite``, ``duckdb``, ``documents`` (JSON lines by collection) or ``frames``."""

    alias: str
    kind: str
    location: str = ""
    options: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str, str]] = field(default_factory=list)


def parse_uri(uri: str) -> tuple[str, str]:
    """Kind and location of a source's URI."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("postgresql", "postgres", "mysql"):
        parts = urlsplit(uri)
        kind, port = ("mysql", 3306) if scheme == "mysql" else ("postgresql", 5432)
        return "jdbc", f"jdbc:{kind}://{parts.hostname}:{parts.port or port}{parts.path}" + (f"?{parts.query}" if parts.query else "")
    if uri.startswith("jdbc:"):
        return "jdbc", uri
    if scheme in ("mongodb", "mongodb+srv"):
        return "mongodb", uri
    if scheme in ("sqlite", "duckdb"):
        return scheme, re.sub(r"^/(?=/)", "", rest)
    if scheme in FILES:
        return scheme, rest
    raise SourceError(f"unknown scheme {scheme!r}")


def credentials(uri: str) -> dict[str, str]:
    """User and password of a URI, as reader options; they stay out of the location."""
    parts = urlsplit(uri) if uri.partition("://")[0] in ("postgresql", "postgres", "mysql") else None
    return {} if parts is None else {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}


class SourceCatalog:
    def __init__(self, spark: SparkSession, hidden: tuple[str, ...] = ()):
        self.spark, self.hidden = spark, set(hidden)
        self.sources: dict[str, Source] = {}
        embedded.register(spark)

    def register(self, alias: str, kind: str, location: str = "", frames: dict[str, DataFrame] | None = None, foreign_keys: list[tuple[str, str, str, str]] | None = None, **options: str) -> Source:
        self.sources[alias] = Source(alias, kind, location, options, dict(frames or {}), list(foreign_keys or []))
        return self.sources[alias]

    def from_uris(self, uris: list[str]) -> list[str]:
        """Aliases are schemes; a second source of a scheme is ``scheme_2``."""
        out = []
        for uri in uris:
            scheme = uri.partition("://")[0].replace("+srv", "")
            scheme = "postgresql" if scheme == "postgres" else scheme
            alias, n = scheme, 1
            while alias in self.sources:
                n += 1
                alias = f"{scheme}_{n}"
            kind, location = parse_uri(uri)
            self.register(alias, kind, location, **credentials(uri))
            out.append(alias)
        return out

    def source(self, alias: str) -> Source:
        if alias not in self.sources:
            raise SourceError(f"unknown source {alias!r}; known: {', '.join(self.sources)}")
        return self.sources[alias]

    def tables(self, alias: str) -> list[str]:
        s = self.source(alias)
        if s.frames:
            names = list(s.frames)
        elif s.kind in FILES or s.kind == "documents":
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(s.location)
            fs = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            names = [re.sub(r"\.\w+$", "", f.getPath().getName()) for f in fs.listStatus(hadoop)]
            names = [n for n in names if not n.startswith(("_", "."))]
        elif s.kind == "sqlite":
            names = [r[0] for r in self._embedded(s, "select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name").collect()]
        elif s.kind == "duckdb":
            names = [r[0] for r in self._embedded(s, "select table_name as name from information_schema.tables where table_schema = 'main' order by 1").collect()]
        elif s.kind == "jdbc":
            schema = "database()" if s.location.startswith("jdbc:mysql:") else "'public'"
            query = "select tablename as name from sys.systables where tabletype = 'T'" if s.location.startswith("jdbc:derby:") else f"select table_name as name from information_schema.tables where table_schema = {schema}"
            names = [r[0] for r in self._jdbc(s, query).collect()]
        else:
            names = []
        return sorted(n for n in names if n not in self.hidden and f"{alias}.{n}" not in self.hidden)

    def _embedded(self, s: Source, query: str) -> DataFrame:
        return self.spark.read.format(f"lodeweave_{s.kind}").options(path=s.location, query=query, **s.options).load()

    def _jdbc(self, s: Source, query: str) -> DataFrame:
        options = {k: v for k, v in s.options.items() if k not in _CUT}
        return self.spark.read.format("jdbc").options(url=s.location, query=query, **options).load()

    def _jdbc_table(self, s: Source, name: str) -> DataFrame:
        """A table in ranges of ``partitionColumn``, whose bounds the database tells unless the options do, in ``numPartitions`` (8) reads."""
        options = dict(s.options)
        key = options.get("partitionColumn")
        if key and "lowerBound" not in options:
            low, high = self._jdbc(s, f"select min({key}) as low, max({key}) as high from {name}").first()
            if low is None:
                options.pop("partitionColumn")
            else:
                options |= {"lowerBound": str(low), "upperBound": str(high), "numPartitions": options.get("numPartitions", "8")}
        return self.spark.read.format("jdbc").options(url=s.location, dbtable=name, **options).load()

    def table(self, alias: str, name: str) -> DataFrame:
        s = self.source(alias)
        if name in self.hidden or f"{alias}.{name}" in self.hidden:
            raise SourceError(f"{alias}.{name} is hidden")
        if s.frames:
            if name not in s.frames:
                raise SourceError(f"no table {name!r} in {alias!r}")
            return s.frames[name]
        if s.kind in FILES:
            extra = {"header": "true", "inferSchema": "true"} if s.kind == "csv" else {}
            return _once(self.spark.read.format(s.kind).options(**{**extra, **s.options}).load(f"{s.location}/{name}.{s.kind}"))
        if s.kind == "documents":
            return self.spark.read.options(**s.options).json(f"{s.location}/{name}.json")
        if s.kind in ("sqlite", "duckdb"):
            return _once(self.spark.read.format(f"lodeweave_{s.kind}").options(path=s.location, table=name, **s.options).load())
        if s.kind == "jdbc":
            return self._jdbc_table(s, name)
        if s.kind == "mongodb":
            return self.spark.read.format("mongodb").options(**{"connection.uri": s.location, "collection": name, **s.options}).load()
        raise SourceError(f"{s.kind} has no tables")

    def query(self, alias: str, query: str | dict) -> DataFrame:
        """A SQL statement, or ``{"collection", "pipeline"}``, over one source's tables."""
        if isinstance(query, dict):
            return docpipe.run(self.table(alias, query["collection"]), query.get("pipeline", []))
        for name in self.tables(alias):
            if re.search(rf"\b{re.escape(name)}\b", query):
                self.table(alias, name).createOrReplaceTempView(name)
        return _once(self.spark.sql(query))

    def sample_column(self, alias: str, table: str, column: str, n: int) -> list:
        """The first ``n`` values that aren't null, in no order."""
        c = F.col(quoted(column))
        return [r[0] for r in self.table(alias, table).where(c.isNotNull()).select(c).limit(n).collect()]

    def connections(self) -> list[dict]:
        out = []
        for alias, s in self.sources.items():
            try:
                names = self.tables(alias)
                if names:
                    self.table(alias, names[0]).limit(1).collect()
                status = "connected"
            except Exception as e:
                status = f"error: {str(e).splitlines()[0]}"
            out.append({"alias": alias, "type": s.kind, "status": status})
        return out

    def close(self) -> None:
        """Readers are lazy and hold nothing open; views are dropped."""
        for alias in self.sources:
            for name in self.sources[alias].frames:
                self.spark.catalog.dropTempView(name)
        self.sources.clear()


def _once(df: DataFrame) -> DataFrame:
    """Of columns with one name the last stays."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    last = {n: i for i, n in enumerate(names)}
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{i}").alias(n) for n, i in last.items()))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Sink for results: files of any of ``FILES``."""
    if kind not in FILES:
        raise SourceError(f"unknown format {kind!r}")
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode(mode).format(kind).save(path)
