"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document is described by shares that its bytes, words and lines give
(``FEATURES``). In a preference pair a text labelled good is preferred to one
labelled poor; the probability of that is the logistic function of the
difference of their scores, and scores are linear in the features, so the fit
is a logistic regression without bias on feature differences. The threshold is
the score quantile at the share of poor texts, over all labelled rows outside
the held-out quarter; scores are mapped so that the threshold stands at 0.7.

Bounds: at most about ``sample`` labelled rows outside the held-out quarter are
read for the fit, and ``pairs`` pairs of them; the model is a few dozen numbers.
For the threshold every text is scored once more and the scores of the labelled
ones are written to the shared checkpoint folder; the driver receives counts of
score bins and the different scores of the one or two bins where it lies.

Defined results: null and empty texts are texts of no words and get that
score; repeated rows get equal scores; an empty table gives no rows. Where the
sample lacks good or poor texts there are no pairs, and each score is 0.7 (kept).
Of equal scores none is preferred: all are above the threshold or none. Texts are
read whole, however long; other columns stay, whatever their names, unless an
output has the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .op1_toxicity import hash_order, training_rows, usable_labels

THRESHOLD = 0.7
SAMPLE = 8_000
PAIRS = 20_000
BINS = 256  # for each unit of score

# Classes of bytes.
_NAMES = ["other", "lower", "upper", "digit", "space", "line", "bar", "bang", "stop", "symbol", "high"]
_CLASS = np.zeros(256, dtype=np.int64)
for _name, _members in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t", "line": b"\n\r", "bar": b"|", "bang": b"!?", "stop": b".,;:", "symbol": b"#$%&*@^~_=+<>{}[]\\", "high": range(128, 256)}.items():
    for _b in _members:
        _CLASS[_b] = _NAMES.index(_name)

FEATURES = [*_NAMES, "log_words", "mean_word", "short_words", "repeats", "distinct_words", "distinct_pairs", "line_words", "distinct_lines", "capital_starts", "one_word_rate", "bar_per_word", "bang_per_word", "symbol_per_word"]


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row; rows are in order."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])] if len(r) else np.zeros(0, dtype=bool)
    return np.bincount(r[new], minlength=n)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    which = np.repeat(np.arange(n, dtype=np.int64) * len(_NAMES), size) + _CLASS[raw]
    counts = np.bincount(which, minlength=n * len(_NAMES)).reshape(n, -1).astype(float)
    start, end, row = words.spans(raw, offsets)
    h = words.hashes(raw, start, end)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    length = end - start
    out = np.empty((n, len(FEATURES)))
    out[:, : len(_NAMES)] = counts / np.maximum(size, 1)[:, None]
    same = row[1:] == row[:-1]
    pair = words.mix(h[:-1] * np.uint64(0xA0761D6478BD642F) + h[1:])[same]
    ls, le, lrow = words.spans(raw, offsets, _NOT_LINE_END)
    lh = words.hashes(raw, ls, le)
    lines = np.bincount(lrow, minlength=n)
    capital = (raw[start] >= 65) & (raw[start] <= 90) if len(start) else np.zeros(0, dtype=bool)
    columns = [
        np.log1p(count) / 10,
        np.bincount(row, length, minlength=n) / some / 10,
        np.bincount(row, length <= 3, minlength=n) / some,
        np.bincount(row[1:], same & (h[1:] == h[:-1]), minlength=n) / some,
        _distinct(row, h, n) / some,
        _distinct(row[1:][same], pair, n) / np.maximum(count - 1, 1),
        np.minimum(count / np.maximum(lines, 1), 50) / 50,
        _distinct(lrow, lh, n) / np.maximum(lines, 1),
        np.bincount(row, capital, minlength=n) / some,
        (count <= 1).astype(float),
        *(np.minimum(counts[:, _NAMES.index(k)] / some, 2) for k in ("bar", "bang", "symbol")),
    ]
    out[:, len(_NAMES) :] = np.stack(columns, axis=1)
    return out


_NOT_LINE_END = np.ones(256, dtype=bool)
_NOT_LINE_END[[10, 13]] = False


@dataclass(frozen=True)
class Model:
    """Features are scaled, then cut into steps ("hinges" at quantiles); ``weight`` is for features and hinges."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float


def _expand(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    hinges = np.maximum(z[:, :, None] - model.knots.T[None], 0).reshape(len(x), -1)
    return np.concatenate([z, hinges], axis=1)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 200, penalty: float = 1e-4, seed: int = 7) -> Model:
    """Accelerated gradient descent on the logistic loss of score differences."""
    k = len(FEATURES)
    if not len(x) or good.all() or not good.any():
        return Model(np.zeros(k), np.ones(k), np.zeros((0, k)), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    knots = np.quantile(z, [0.05, 0.35, 0.65, 0.95], axis=0)
    model = Model(mean, scale, knots, np.zeros(0), 0.0, 1.0)
    wide = _expand(x, model)
    rng = np.random.default_rng(seed)
    win, lose = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    diff = (wide[win] - wide[lose]).astype(np.float32)
    w = np.zeros(wide.shape[1], dtype=np.float32)
    momentum, rate = w, np.float32(4 * pairs / max(1.0, np.linalg.norm(diff.T @ diff, 2)))
    for i in range(rounds):
        g = -(diff.T @ (1 / (1 + np.exp(diff @ momentum)))) / pairs + penalty * momentum
        ahead = momentum - rate * g
        momentum, w = ahead + np.float32(i / (i + 3)) * (ahead - w), ahead
    s = wide @ w
    threshold = float(np.quantile(s, 1 - good.mean()))
    spread = float(np.quantile(s, 0.9) - np.quantile(s, 0.02)) or 1.0
    return Model(mean, scale, knots, w, threshold, 6 / spread)


def raw_scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _expand(features(raw, offsets), model) @ model.weight


def scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """From 0 to 1; the threshold's quantile stands at 0.7."""
    s = raw_scores(model, raw, offsets)
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    # 1e-9: what stands at the threshold is kept, however the logistic function rounds.
    return np.clip(1 / (1 + np.exp(-np.clip(model.slope * (s - model.threshold) + at, -35, 35))) + 1e-9, 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, pairs: int = PAIRS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample; its features, found on the executors, are what the driver receives."""
    common.small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = features(*words.flat(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "label": batch.column("label"), "x": [v.tobytes() for v in x]})

    got = training_rows(docs, labels, label, sample, doc_id, text).mapInArrow(describe, "id string, label int, x binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda k: hash_order(got["id"][k].as_py()))
    x = np.array([np.frombuffer(got["x"][k].as_py()) for k in order]).reshape(-1, len(FEATURES))
    return calibrated(fit(x, got["label"].to_numpy()[order] == 1, pairs), docs, labels, label, doc_id, text)


def calibrated(model: Model, docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """``model`` with its threshold at the exact quantile over all labelled rows outside the held-out quarter."""
    if not model.weight.any():
        return model

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "s": pa.array(raw_scores(model, *words.flat(batch.column("text"))))})

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("s", T.DoubleType())])
    rated = docs.select(F.col(doc_id).alias("id"), common.whole_text(docs, text).alias("text")).mapInArrow(rate, schema)
    rows = common.written(rated.join(usable_labels(labels, label, doc_id), "id").select("s", "label"))
    place = F.floor(F.col("s") * BINS)
    bins = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    if not bins:
        return model
    n, below = sum(b["n"] for b in bins), np.cumsum([b["n"] for b in bins])
    rank = (1 - sum(b["good"] for b in bins) / n) * (n - 1)
    low, high = int(rank), min(int(rank) + 1, n - 1)
    first, last = (int(np.searchsorted(below, r, side="right")) for r in (low, high))
    near = rows.where(place.isin(bins[first]["bin"], bins[last]["bin"])).groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()
    upto = np.cumsum([r["n"] for r in near]) + (below[first] - bins[first]["n"])
    a, b = (near[int(np.searchsorted(upto, r, side="right"))]["s"] for r in (low, high))
    return replace(model, threshold=a + (b - a) * (rank - low))


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with each whole text's score from 0 to 1 in ``output``, which replaces a column of that name."""
    common.small_batches(df.sparkSession)
    kept = common.others(df, (output,))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {output: pa.array(scores(model, *words.flat(batch.column(text))))})

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches the threshold, with their columns."""
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model, output="__quality").where(F.col("__quality") >= THRESHOLD).select(*docs.columns)
