"""BPE encoding and decoding of a text column.

The merges run in batched numpy rounds (``bpe.WordBpe``); a task reads its
rows once, in slices of about two megabytes of text, and nothing is shuffled.

Defined results: a null or empty text gives no ids and an empty decoded text;
repeated rows give repeated rows; white space alone gives no ids; a table
without rows gives a table without rows. Other columns, whatever their names,
stay as they are unless they bear one of the two output names, which replace them.
Texts are read whole, however long; ranks decide every merge, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(df: DataFrame, path: str | Callable[[], str] = vocabulary_path, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with its texts' ids (binary: little-endian unsigned 32-bit integers) and the text that these ids stand for.

    ``path`` names the vocabulary file where the executors find it, or is called there to learn it.
    """
    common.small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path() if callable(path) else path)
        for batch in common.slices(batches, text):
            flat, counts = coder.encode_batch(common.strings(batch.column(text)))
            raw, listed = flat.astype("<u4", copy=False).tobytes(), flat.tolist()
            ends = np.cumsum(counts).tolist()
            starts = [0, *ends[:-1]]
            columns = {c: batch.column(c) for c in kept}
            columns[ids] = pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())
            columns[decoded] = pa.array([coder.decode(listed[a:b]) for a, b in zip(starts, ends, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
