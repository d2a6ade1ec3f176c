"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the buckets of its words, of its word pairs and of
its words two apart (presence, not counts). FTRL-proximal gives each bucket its
own learning rate and an L1 penalty, so few weights differ from zero; these few
are broadcast to the tasks that score. A text is read once and nothing is
shuffled.

Bounds: the model is fitted on a sample of at most about ``sample`` labelled
rows outside the held-out quarter, drawn by a hash of the id; the weights
number ``1 << BITS`` at most, and ``MAX_WEIGHTS`` bytes bound the broadcast.

Defined results: null and empty texts get the score of the bias alone; repeated
rows get equal scores; an empty table gives no rows; where no row is labelled,
the score is 0.5 for all. Labels that are null are not learned; where an id has
several labels, the mean, rounded up at a half, counts. Rows of the sample are
learned in the order of a hash of their ids. Texts are
read whole, however long; other columns stay, whatever their names, unless an
output has the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

BITS = 20
MAX_WEIGHTS = 16 << 20
SAMPLE = 8_000
THRESHOLD = 0.3
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Model:
    """Buckets whose weight isn't zero, in order, their weights, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 4


def buckets(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each n-gram and skip-gram, with repeats."""
    start, end, row = words.spans(raw, offsets)
    h = words.hashes(raw, start, end)
    rows, keys = [row], [h]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[:-gap] == row[gap:]
        keys.append(words.mix(h[:-gap] * salt + h[gap:])[same])
        rows.append(row[gap:][same])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def unique_buckets(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The distinct buckets of each row."""
    row, key = buckets(raw, offsets, bits)
    both = np.unique((row << bits) | key)
    cut = np.searchsorted(both, np.arange(len(offsets)) << bits)
    both &= (1 << bits) - 1
    return [both[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, how: Ftrl = Ftrl()) -> Model:
    """FTRL-proximal in the order of the rows; the bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= how.l1, 0.0, -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2))

    for _ in range(how.epochs if len(rows) else 0):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            bias = -zb / ((how.beta + nb**0.5) / how.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
            z[i] += g - step * w
            n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / how.alpha * bias
            nb += g * g
    live = np.flatnonzero(np.abs(z) > how.l1)
    return Model(live, weights(live), -zb / ((how.beta + nb**0.5) / how.alpha))


def scores(model: Model, raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    table = np.zeros(1 << bits, dtype=np.float32)
    table[model.bucket] = model.weight
    return _scores(table, model.bias, raw, offsets, bits)


def _scores(table: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    row, key = buckets(raw, offsets, bits)
    live = table[key] != 0
    both = np.unique((row[live] << bits) | key[live])
    total = np.bincount(both >> bits, table[both & ((1 << bits) - 1)], minlength=len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def usable_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """``id`` and ``label`` of the labelled rows outside the held-out quarter."""
    return (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("id")))
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and labels of a hash sample of about ``sample`` labelled rows outside the held-out quarter, as ``text`` and ``label``."""
    usable = usable_labels(labels, label, doc_id)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    chosen = usable.where(draw < int(1_000_000 * min(1.0, sample / max(1, usable.count()))))
    texts = docs.select(F.col(doc_id).alias("id"), common.whole_text(docs, text).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")  # the sample bounds what is broadcast


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, how: Ftrl = Ftrl(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample; its buckets, found on the executors, are what the driver receives."""
    common.small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = unique_buckets(*words.flat(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "label": batch.column("label"), "buckets": [x.astype("<i4").tobytes() for x in found]})

    got = training_rows(docs, labels, label, sample, doc_id, text).mapInArrow(features, "id string, label int, buckets binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda k: hash_order(got["id"][k].as_py()))
    y = got["label"].to_numpy()
    return fit([np.frombuffer(got["buckets"][k].as_py(), dtype="<i4") for k in order], y[order], how=how)


def hash_order(key: str) -> tuple[int, str]:
    import zlib

    return zlib.crc32(key.encode() + b"/order"), key


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with each whole text's score from 0 to 1 in ``output``, which replaces a column of that name."""
    spark = df.sparkSession
    common.small_batches(spark)
    if model.bucket.nbytes + model.weight.nbytes > MAX_WEIGHTS:
        raise ValueError("the model has more weights than may be broadcast; raise the L1 penalty")
    sent = spark.sparkContext.broadcast(model)
    kept = common.others(df, (output,))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[own.bucket] = own.weight
        for batch in common.slices(batches, text):
            found = _scores(table, own.bias, *words.flat(batch.column(text)), BITS)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {output: pa.array(found)})

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
