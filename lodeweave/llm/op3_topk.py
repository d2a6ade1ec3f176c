"""Exact top-k search by inner product, with M-trees over metric shards.

1. At most ``PIVOTS`` rows, drawn by a hash, are pivots; each row goes to the
   cell of its nearest one, and cells of over ``SHARD`` rows are dealt into
   shards by a hash, so copies of one vector, however many, spread evenly.
2. Each shard's M-tree is built once and written, with the covering radius of the
   shard around its pivot.
3. Each query is answered by the shard that can hold the largest product. Its
   k-th product there is its bound, and it goes on only to shards whose pivot and
   radius allow as much; these search with the bound. A task answers the queries
   of one block, about ``BLOCK``, in one shard.
4. The best ``k`` of all that a query got are its answer.

On vectors without structure no radius excludes a shard, and each query meets
each; on clustered ones most are left out. Results are exact either way.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, neither as rows nor as queries; vectors of other lengths count as
if they ended in zeros; rows that repeat an id are candidates of their own, for
queries of other ids, and queries that repeat an id are answered as one, by the
best of their products; ties go to smaller ids; an empty table gives no rows; a
query with fewer candidates gets them all. Other columns are not read. The
products must fit 53 bits, which components below two million do in 1,000 dimensions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .mtree import SLACK, MTree

SHARD, BLOCK = 8192, 4096
#: Bounds of what the driver holds: pivots, and shards' radii.
PIVOTS, SHARDS = 1024, 100_000


def quantised(vector: str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, or null where a vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), dtype=np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("v"))).first()[0] or 0


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables of ``vec_id`` and ``v`` (integers, not null)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), "v")
    total, asking = rows.count(), queries.count()
    width = max(_width(rows), _width(queries))
    shard = max(shard, -(-total // SHARDS))
    drawn = rows.orderBy(F.xxhash64("v"), "vec_id").limit(min(PIVOTS, max(1, total // shard))).collect()
    pivots = np.zeros((max(1, len(drawn)), width))
    for i, r in enumerate(drawn):
        pivots[i, : len(r["v"])] = r["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(_matrix(batch.column("v"), width).astype(np.float64), pivots)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cell": pa.array(cell.astype(np.int32))})

    placed = common.checkpointed(rows.mapInArrow(assign, "vec_id long, v array<long>, cell int"))
    size = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [-(-size.get(c, 0) // shard) for c in range(len(pivots))]
    first = np.r_[0, np.cumsum(parts)].tolist()
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    home = (at(first[:-1]) + F.pmod(F.xxhash64("vec_id", "v"), F.greatest(at(parts), F.lit(1)))).cast("int")

    def build(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"], width)
        cell, number = table["cell"][0].as_py(), table["shard"][0].as_py()
        radius = float(np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)).max())
        tree = MTree(table["vec_id"].to_numpy(), x, copies=k + 1)
        return pa.table({"shard": pa.array([number], pa.int32()), "cell": pa.array([cell], pa.int32()), "radius": [radius], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = common.written(placed.select("vec_id", "v", "cell", home.alias("shard")).groupBy("shard").applyInArrow(build, "shard int, cell int, radius double, tree binary"))
    known = trees.select("shard", "cell", "radius").collect()
    numbers = np.array([r["shard"] for r in known], dtype=np.int32)
    radius, center = np.array([r["radius"] for r in known]), np.array([r["cell"] for r in known], dtype=np.int64)

    def send(rest: bool):
        """Rows of a query and a shard that it asks: the most promising one, or the others that its bound allows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(numbers):
                    continue
                x = _matrix(batch.column("v"), width).astype(np.float64)
                far = np.sqrt((x**2).sum(axis=1))[:, None]
                most = (x @ pivots.T)[:, center] + far * radius
                most += SLACK * (1 + far) * (1 + radius)
                best = most.argmax(axis=1)
                if rest:
                    least = batch.column("least").to_numpy(zero_copy_only=False)
                    ask = ~(most < np.where(np.isnan(least), -np.inf, least)[:, None])
                    ask[np.arange(len(best)), best] = False
                    who, where = np.nonzero(ask)
                else:
                    who, where = np.arange(len(best)), best
                take = pa.array(who)
                yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id").take(take), "v": batch.column("v").take(take), "least": batch.column("least").take(take), "shard": pa.array(numbers[where])})

        return run

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if data.num_rows and asked.num_rows:
            tree = pickle.loads(data["tree"][0].as_py())
            least = asked["least"].to_pylist()
            for name, point, low in zip(asked["query_id"].to_pylist(), _matrix(asked["v"], width), least, strict=True):
                found, score = tree.search(point, k, own=name, least=low)
                out[0].append(np.full(len(found), name))
                out[1].append(found)
                out[2].append(score)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    blocks = max(1, -(-asking // block))

    def answers(ready: DataFrame, rest: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        asked = common.checkpointed(ready.mapInArrow(send(rest), "query_id long, v array<long>, least double, shard int").select("*", own))
        pairs = asked.select(F.col("shard").alias("of"), F.col("block").alias("part")).distinct()
        data = trees.select("shard", "tree").join(pairs, F.col("shard") == F.col("of")).select("of", "part", "tree")
        return data.groupBy("of", "part").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")

    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = common.checkpointed(answers(queries.withColumn("least", F.lit(None).cast("double")), False))
    bounds = one.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("least"))
    others = answers(queries.join(bounds, "query_id", "left").select("query_id", "v", "least"), True)
    return one.unionAll(others).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("v")).where("vec_id is not null and v is not null")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
