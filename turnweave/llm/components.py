"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the links alone; the links of a node
with very many neighbours are aggregated before they are shuffled, but its join keeps them
in one task. Lineage is cut after every round by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these; here a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with a link; component: the smallest node that can be reached.

    ``links`` has two integer columns a and b. Links of a node with itself and null ends
    are ignored, repeated and reversed links count once; no links give no rows.
    """
    now = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = checkpointed(now)
    mark = None
    for _ in range(max_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
