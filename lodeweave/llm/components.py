"""Connected components of an edge table, by repeated large-star and small-star joins.

Each round every node learns its smallest neighbour and passes that on to its
other neighbours; both sides of a round are grouped by node with partial
aggregates, nodes with very many neighbours are looked up by broadcast
(``common.looked_up``), and rounds are written to the shared checkpoint folder, so lineage
stays short and lost executors cost one round. Edges never reach the driver;
only two numbers of each round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for each node of ``edges``; the root is the smallest node of its component.

    Nulls, loops and repeated edges count for nothing; without edges there are no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = common.checkpointed(e)
    state, size = None, e.count()
    for _ in range(most_rounds):
        # Large star: larger neighbours of each node get its smallest neighbour.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = common.looked_up(both, least, "u", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its smaller neighbours get the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = common.looked_up(large, least, "u", 2 * size)
        small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.checkpointed(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, size = now, now[0]
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
