"""Media columns: texts as FLAC streams of 8-bit samples, and PCM blocks read back from them.

``store`` pads a text's UTF-8 bytes with 255 to whole blocks of 576 samples and
writes a FLAC stream; ``restore`` decodes Rice residuals and linear predictors
from the stored bytes, verifies each frame's checksums and the stream's MD5, and
computes features; ``pcm_blocks`` writes the samples as rows with their sample
offsets. Every row is handled where it is read; nothing is shuffled.

Defined results: null and empty texts are one block of 255; repeated rows and
equal texts give equal streams; an empty table gives no rows; a damaged stream
raises ``flac.FlacError``; texts are read whole, and the frames of one text are in
memory together, at some tens of its bytes. Other columns stay, whatever their names, unless an
output has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, flac, words


def store(df: DataFrame, text: str = "text", output: str = "media", lpc: int = 0) -> DataFrame:
    """``df`` with each whole text's stream in ``output`` and its unpadded length in ``n_bytes``, instead of ``text``."""
    common.small_batches(df.sparkSession)
    kept = [c for c in common.others(df, (output, "n_bytes")) if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField(output, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, 1 << 20):
            raw, offsets = words.flat(batch.column(text))
            size = np.diff(offsets)
            frames = np.maximum(1, -(-size // flac.BLOCK))
            payload = np.full(int(frames.sum()) * flac.BLOCK, 255, dtype=np.uint8)
            shift = (np.cumsum(frames) - frames) * flac.BLOCK - offsets[:-1]
            payload[np.arange(len(raw)) + np.repeat(shift, size)] = raw
            streams = flac.encode(payload, frames, lpc)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"n_bytes": pa.array(size), output: pa.array(streams, pa.binary())})

    return df.mapInArrow(run, schema)


def features(payload: np.ndarray, blocks: np.ndarray) -> list[str]:
    """Blocks, root mean square, zero crossings and mean step of each payload's samples, as text."""
    x = payload.astype(np.int64) - 128
    size = blocks * flac.BLOCK
    start = np.cumsum(size) - size
    power = np.add.reduceat(x * x, start)
    step = np.abs(np.diff(x, append=x[-1:]))
    crossing = (np.diff(x >= 0, append=x[-1:] >= 0)).astype(np.int64)
    step[start + size - 1] = 0
    crossing[start + size - 1] = 0
    return [f"blocks={b};rms={(p / n) ** 0.5:.4f};crossings={c};step={s / n:.4f}" for b, n, p, c, s in zip(blocks.tolist(), size.tolist(), power.tolist(), np.add.reduceat(crossing, start).tolist(), np.add.reduceat(step, start).tolist(), strict=True)]


def restore(df: DataFrame, media: str = "media", output: str = "payload", feature: str = "feature") -> DataFrame:
    """``df`` with the bytes that its streams hold in ``output`` and their features; a null stream gives null."""
    kept = common.others(df, (output, feature))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.BinaryType()), T.StructField(feature, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, media, 1 << 20):
            streams = batch.column(media).to_pylist()
            some = [i for i, s in enumerate(streams) if s is not None]
            back: list = [None] * len(streams)
            said: list = [None] * len(streams)
            if some:
                payload, blocks = flac.decode([streams[i] for i in some])
                raw, ends = payload.tobytes(), (np.cumsum(blocks) * flac.BLOCK).tolist()
                for i, a, b, f in zip(some, [0, *ends[:-1]], ends, features(payload, blocks), strict=True):
                    back[i], said[i] = raw[a:b], f
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {output: pa.array(back, pa.binary()), feature: pa.array(said, pa.string())})

    return df.mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, media: str = "media", frames: int = 64) -> DataFrame:
    """A row for every ``frames`` blocks of each stream: the other columns, ``sample_offset`` and ``pcm``."""
    size = frames * flac.BLOCK
    payload = restore(df, media, "__payload", "__feature").drop("__feature", media).where(F.col("__payload").isNotNull())
    kept = [F.col(c) for c in payload.columns if c != "__payload"]
    cut = F.sequence(F.lit(0), F.length("__payload") - 1, F.lit(size))
    rows = payload.select(*kept, "__payload", F.explode(cut).alias("sample_offset")).withColumn("sample_offset", F.col("sample_offset").cast("long"))
    return rows.select(*kept, "sample_offset", F.expr(f"substring(__payload, cast(sample_offset + 1 as int), {size})").alias("pcm"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return restore(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
