"""Connected components of an edge table by hooking and pointer jumping, a few joins per round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    ``keep`` cuts lineage once a round (a checkpoint, or a table in a shared folder). Each round a node
    takes the least grandparent among its neighbours, its parent does so too, and it jumps to its own
    grandparent; that ends after about as many rounds as the logarithm of the longest path.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    parents = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    for _ in range(most_rounds):
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        jumped = keep(parents.join(up, "root").select("node", "root", "grand"))
        near = both.join(jumped.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("least"))
        near = keep(near.select(F.col("a").alias("node"), "least"))
        hooked = jumped.join(near, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        proposed = jumped.select("node", F.col("grand").alias("root")).union(near.select("node", F.col("least").alias("root"))).union(hooked)
        after = keep(proposed.groupBy("node").agg(F.min("root").alias("root")))
        changed = after.join(parents.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        parents = after
        if not changed:
            return parents
    raise RuntimeError("components did not settle")
