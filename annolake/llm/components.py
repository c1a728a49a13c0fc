"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label of that label; tables
    are written between rounds, so a lost executor costs one round at most. Repeated edges and
    loops are allowed; no edges give no rows.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("id", "to"), "cc-edges"
    )
    labels = written(
        both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "cc-labels"
    )
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("c")), "to")
        least = near.groupBy("id").agg(F.min("c").alias("c"))
        stepped = labels.join(least, "id").select("id", F.least("component", "c").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("c"))
        moved = written(
            stepped.join(jump, "to").select("id", F.least("to", "c").alias("component"), "was"), "cc-labels"
        )
        labels = moved.select("id", "component")
        if not moved.where(F.col("component") != F.col("was")).limit(1).count():
            return labels
