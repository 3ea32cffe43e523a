"""Connected components without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.sources.shared import cut, cut_counted, drop_cut


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """id, component (its smallest id): smallest-label propagation with pointer jumping; each round is cut through the shared folder.

    ``edges``: x, y; ``nodes``: id.  A node without edges is its own component; self-loops and repeated edges change nothing.
    """
    label = cut(nodes.select("id", F.col("id").alias("c")).distinct())
    both, n = cut_counted(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct())
    if not n:
        return label.select("id", F.col("c").alias("component"))
    for _ in range(rounds):
        best = both.join(label.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("c").alias("m"))
        step = label.join(best.withColumnRenamed("x", "id"), "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("new"))
        jump, changed = cut_counted(step.join(step.select(F.col("id").alias("_i"), F.col("new").alias("_n")), F.col("new") == F.col("_i")).select("id", "c", F.col("_n").alias("new")), "c <> new")
        drop_cut(label)
        if not changed:
            drop_cut(both)
            return jump.select("id", F.col("new").alias("component"))
        label = jump.select("id", F.col("new").alias("c"))
    raise RuntimeError(f"no fixed point within {rounds} rounds")
