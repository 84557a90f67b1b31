"""Connected components of an edge table by iterative Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import saved


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, label): the smallest id of each id's component, from edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that label (so paths halve),
    and is written to the shared folder. It ends when a round changes nothing; `rounds` only guards against a bug, and
    exceeding it is an error.
    """
    both = saved(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        moved = saved(least.join(jump, "low").select("id", F.col("label").alias("old"), F.least("low", "far").alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
