"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two
fingerprints with at most four differing bits, one segment differs in at most
one (five bits are needed to differ twice in each). So each distinct fingerprint
is indexed under 64 keys, one for each bit: the segment that holds the bit,
with the bit deleted. Fingerprints that share a key are compared exactly.

Equal fingerprints are one node, whatever the number of documents. A key's
fingerprints emit a spanning forest of its links, never all pairs; a key with
more than ``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is
a unit of its own, so no task holds more than two blocks of a key.

Defined results: null, empty and blank texts have no words and fingerprint
zero, which links like any other; a text of fewer than ``width`` words has one
shingle, the whole sequence; repeated rows stay; an empty table gives no rows.
Rows without an id are fingerprinted, and join the component of the
fingerprint; a component without any id has a null id. Rows that repeat an id
are one document: each has its own fingerprint, and the stage keeps or drops
them together. Texts are read whole, however long. Of other columns none is
read, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .components import components

WIDTH, DISTANCE, BLOCK = 4, 4, 4096
CHUNK_ROWS = 1 << 18
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def fingerprints(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the rows' word shingles."""
    n = len(offsets) - 1
    low = words.LOWER[raw]
    start, end, row = words.spans(low, offsets, _WORD)
    if not len(start):
        return np.zeros(n, dtype=np.uint64)
    # Words of a row stand one space apart in `joined`.
    size = end - start
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(at[-1] + size[-1] + 1), 32, dtype=np.uint8)
    joined[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = low[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    count = np.bincount(row, minlength=n)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first_word = np.cumsum(count) - count
    owner = np.repeat(np.arange(n), shingles)
    first = first_word[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.where(count[owner] >= width, first + width - 1, first + count[owner] - 1)
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], 42) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), dtype=np.uint64, count=len(first))
    out = np.zeros(n, dtype=np.uint64)
    some = np.flatnonzero(shingles)
    begin = (np.cumsum(shingles) - shingles)[some]
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), begin)
        out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint(df: DataFrame, text: str = "text", output: str = "fp", width: int = WIDTH) -> DataFrame:
    """``df`` without ``text``, and the fingerprint of each whole text as a signed 64-bit number."""
    common.small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, output)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            found = fingerprints(*words.flat(batch.column(text)), width)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {output: pa.array(found.view(np.int64))})

    return df.mapInArrow(run, schema)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[list, list]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            hit = _near(fps[i], fps[rest], distance)
            if hit.any():
                got = rest[hit]
                left.append(np.full(len(got), fps[i]))
                right.append(fps[got])
                reached.extend(got.tolist())
                rest = rest[~hit]
    return left, right


def between(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> tuple[list, list]:
    """Edges of a spanning forest of the links that lead from ``a`` to ``b``."""
    left, right = [], []
    sides, rest = (a, b), [np.arange(len(a)), np.arange(len(b))]
    while len(rest[0]) and len(rest[1]):
        reached = [(0, rest[0][0])]
        rest[0] = rest[0][1:]
        while reached:
            side, k = reached.pop()
            other = rest[1 - side]
            if not len(other):
                continue
            hit = _near(sides[side][k], sides[1 - side][other], distance)
            if hit.any():
                got = other[hit]
                left.append(np.full(len(got), sides[side][k]))
                right.append(sides[1 - side][got])
                reached.extend((1 - side, g) for g in got.tolist())
                rest[1 - side] = other[~hit]
    return left, right


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges, each node but a root linked to its component's smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def links(prints: DataFrame, fp: str = "fp", distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links among the distinct fingerprints of ``prints``."""
    if distance >= 2 * len(SEGMENTS):
        raise ValueError("three segments find at most five differing bits")
    keys = []
    for start, width in SEGMENTS:
        for bit in range(start, start + width):
            mask = ((1 << width) - 1) << start & ~(1 << bit)
            signed = mask - (1 << 64) if mask >> 63 else mask
            # The deleted bit and what is left of its segment, in 6 + 22 bits.
            keys.append(F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(signed).cast("long")), start).bitwiseOR(F.lit(bit << 22).cast("long")).cast("int"))
    spark = prints.sparkSession
    # The nodes are written once, in as many partitions as tasks can share: each node becomes 64 rows.
    nodes = common.checkpointed(prints.select(F.col(fp).alias("fp")).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp"))
    index = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    # A key's size is that of two segment values, so counts of values (three a node) tell which keys are large.
    parts = [F.struct(F.lit(k).alias("segment"), F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int").alias("value")) for k, (start, width) in enumerate(SEGMENTS)]
    values = nodes.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.segment", "x.value").agg(F.count("*").alias("n")).where(F.col("n") > block / 2)
    bits = F.explode(F.expr("case segment " + " ".join(f"when {k} then sequence({start}, {start + width - 1})" for k, (start, width) in enumerate(SEGMENTS)) + " end")).alias("bit")
    first = "case segment " + " ".join(f"when {k} then {start}" for k, (start, _) in enumerate(SEGMENTS)) + " end"
    value_key = F.expr(f"(value & ~shiftleft(1, bit - {first})) | shiftleft(bit, 22)").alias("key")
    large = values.select("segment", "value", "n", bits).select(value_key, "n").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    large = common.checkpointed(large)
    unit = index
    if large.isEmpty():
        unit = index.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # Each large key has over half a block of nodes for one of its values; of 64 keys a node, these are few.
        unit = index.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        unit = unit.select("key", "own", "fp", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def edges(key: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Edges of whole units, which stand one after the other."""
        fps = fps.view(np.uint64)
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[_near(fps[two], fps[two + 1], distance)]
        left, right = [fps[two]], [fps[two + 1]]
        for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            part = slice(s, s + n)
            if i[s] == j[s]:
                found = forest(fps[part], distance)
            else:
                mine = own[part] == i[s]
                found = between(fps[part][mine], fps[part][~mine], distance)
            if found[0]:
                left += found[0]
                right += found[1]
        a, b = _spanning(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units in order; only the last, unfinished one is carried over."""
        carry: list[np.ndarray] | None = None
        for table in common.chunks(batches, CHUNK_ROWS):
            held = [table[k].to_numpy() for k in ("key", "i", "j", "own", "fp")]
            held = held if carry is None else [np.concatenate(x) for x in zip(carry, held, strict=True)]
            key, i, j = held[:3]
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[-1])
            if last:
                yield edges(*(x[:last] for x in held))
            carry = [x[last:] for x in held]
        if carry is not None:
            yield edges(*carry)

    return unit.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``df``: ``doc_id``, ``fp`` and ``component_id``, the smallest id that its links reach."""
    prints = common.checkpointed(fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    tree = components(links(prints, distance=distance))
    joined = common.checkpointed(least.join(tree, least["fp"] == tree["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    size = joined.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    # A component may hold a third of the fingerprints, and a fingerprint a third of the rows.
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    classes = common.looked_up(joined, roots, "root", size["nodes"], "nodes").select("fp", "component_id", "n")
    return common.looked_up(prints, classes, "fp", size["rows"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, the one with the smallest id; rows without an id stay."""
    found = near_duplicates(docs)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
