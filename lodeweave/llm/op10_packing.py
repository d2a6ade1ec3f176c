"""Best-fit packing of tokenised documents, by bin completion on counts of lengths.

Texts are tokenised once, cut into pieces where they exceed the capacity, and
the pieces are written to the shared checkpoint folder. Only the number of
pieces of each length goes to the driver, ``capacity`` numbers at most, where
``binpack.pack`` finds the fillings. Each filling takes a range of ranks among
the pieces of a length, so a piece finds its place by its rank and one broadcast
of the ranges; they number at most ``MAX_RANGES``, which is checked.

Ranks are counted within salted groups of a length, then shifted by the counts
of the groups before, so one length may have any share of the rows.

Defined results: a null or empty text has the end id alone; repeated rows are
pieces of their own; an empty table gives no rows; rows with a null id are
packed like others. Pieces of one length are placed in the order of their ids,
pieces, starts and checksums; which of fully equal ones comes first is no
difference. Texts are read whole, however long; of other columns none is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binpack, bpe, common
from .op5_bpe import vocabulary_path

CAPACITY, END = 4096, 1
GROUP_ROWS = 2_000
MAX_RANGES = 200_000
WORK = 3_000_000


def pieces(df: DataFrame, path: str | Callable[[], str] = vocabulary_path, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32``, and with ``keep_ids`` the ids as little-endian unsigned 32-bit integers."""
    common.small_batches(df.sparkSession)
    df = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [df.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path() if callable(path) else path)
        for batch in common.slices(batches):
            flat, counts = coder.encode_batch(common.strings(batch.column("text")))
            # The end id after each document's ids.
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, END).astype("<u4", copy=False)
            ends = ends + np.arange(1, len(ends) + 1)
            size = counts + 1
            parts = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, size[owner] - start)
            at = ((ends - size)[owner] + start) * 4
            raw = flat.tobytes()
            cut = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = {"doc_id": batch.column("doc_id").take(pa.array(owner)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(cut, pa.binary())} if keep_ids else {}))

    return df.mapInArrow(run, T.StructType(fields))


def ranges(fillings: list[binpack.Filling]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first, last, each, sequence, offset``: ranks of a length from first to before last go to sequences from ``sequence`` on, ``each`` to one, from ``offset`` on."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for items, bins in fillings:
        offset = 0
        for length, each in items:
            first = taken.get(length, 0)
            taken[length] = first + each * bins
            out.append((length, first, taken[length], each, sequence, offset))
            offset += each * length
        sequence += bins
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, work: int = WORK) -> DataFrame:
    """``found``, which has the columns of ``pieces``, with ``sequence_id`` and ``offset``."""
    found = common.checkpointed(found)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = ranges(binpack.pack(counts, capacity, work).fillings)
    if len(rows) > MAX_RANGES:
        raise ValueError("the fillings are too many to broadcast")
    spark = found.sparkSession
    where = spark.createDataFrame(rows, "length long, first long, last long, each long, sequence long, at long")

    salts = max(1, -(-max(counts.values(), default=1) // GROUP_ROWS))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1)
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("n", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n"))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("n"))
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).drop(where["length"])
    step = F.col("rank") - F.col("first")
    return placed.select(
        *found.columns,
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (step % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document."""
    return pack(pieces(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, common.read(spark, sf_dir, "documents"), sf_dir)
