"""Connected components of a link table by minimum labels, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.common import staged


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, comp) of every node that has a link (a, b); comp is the least id it reaches.

    Each round takes the least label among neighbours and then that label's own
    label (pointer jumping), so paths shorten by doubling; labels are written
    between rounds.  Stops when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.where("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    for _ in range(rounds):
        near = (
            edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        )
        low = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("id").alias("__id"), F.col("comp").alias("__far"))
        step = low.join(jump, F.col("comp") == F.col("__id")).select("id", "old", F.least("comp", "__far").alias("comp"))
        step = staged(step, "labels")
        moved = step.where("old <> comp").limit(1).count()
        labels = step.select("id", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
