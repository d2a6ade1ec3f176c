"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker, in UTF-8 bytes.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[text], F.lit(""))


def others(df: DataFrame, outputs: tuple[str, ...]) -> list[str]:
    """The columns of ``df`` that no output replaces; names are alike in either case, as Spark reads them."""
    taken = {x.lower() for x in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, or one row.

    Spark bounds its batches by rows, so this bounds what the code after it
    holds in its own arrays, however long single texts are.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(lengths):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int | None = None) -> Iterator[pa.Table]:
    """Small batches as tables of about ``rows`` rows, or ``size`` bytes."""
    got, n, held = [], 0, 0
    for b in batches:
        if b.num_rows:
            got.append(b)
            n += b.num_rows
            held += b.nbytes
        if n >= rows or (size and held >= size):
            yield pa.Table.from_batches(got)
            got, n, held = [], 0, 0
    if got:
        yield pa.Table.from_batches(got)


#: Keys that ``looked_up`` takes as hot, at most, and the rows that a key may always have.
HOT_KEYS, KEY_ROWS = 10_000, 4_096


def looked_up(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``left`` joined to ``right`` by ``key``; ``right`` has a row for each key, with the number of its rows in ``left`` in ``count``.

    A key with over ``total / HOT_KEYS`` of the ``total`` rows is hot. There are
    ``HOT_KEYS`` of these at most, so they are broadcast and their rows stay
    where they are; the others are joined by a shuffle, evenly.
    """
    most = max(KEY_ROWS, -(-total // HOT_KEYS))
    if total <= most:
        return left.join(right.drop(count), key)
    columns = [c for c in right.columns if c not in (key, count)]
    hot = right.where(F.col(count) > most).select(key, F.struct(*columns).alias("found"))
    marked = left.join(F.broadcast(hot), key, "left")
    rest = marked.where("found is null").drop("found").join(right.where(F.col(count) <= most).drop(count), key)
    here = marked.where("found is not null").select(*left.columns, "found.*")
    return here.unionByName(rest)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a folder in the warehouse, which executors share too."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodeweave")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows in a batch for a Python worker: whole texts can be long, and Spark bounds its batches by rows only.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, so that a worker never holds ten thousand long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def strings(column: pa.Array) -> list[str]:
    """A text column as a list, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back; many small rows take less room than by ``checkpointed``.

    The shuffle files behind it are no longer needed, and are released. The
    table goes when the application ends.
    """
    import gc
    import time
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodeweave-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    del df
    # The listeners of the write hold its plan until they have heard of its end.
    time.sleep(0.5)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
