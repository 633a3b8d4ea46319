"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.operators.fixpoint import cut


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, label) with the smallest id of each component. nodes(id), edges(a, b) in any direction.

    Every round hooks labels onto the smallest neighbouring label, also through the label's own
    root, and then jumps pointers, so rounds grow with the logarithm of the diameter.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    f = cut(nodes.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(max_rounds):
        near = both.join(f.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = f.join(near, "id", "left").withColumn("m", F.least("m", "label"))
        roots = low.where("m < label").groupBy(F.col("label").alias("root")).agg(F.min("m").alias("r"))
        hooked = low.join(roots.select(F.col("root").alias("id"), "r"), "id", "left").select("id", F.least("m", "r").alias("p"), "label")
        jump = hooked.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        new = cut(hooked.join(jump, "p", "left").select("id", F.least("p", "pp").alias("label"), (F.least("p", "pp") < F.col("label")).alias("moved")))
        f = new.select("id", "label")
        if new.where("moved").isEmpty():
            return f
    raise RuntimeError(f"components did not settle after {max_rounds} rounds")
