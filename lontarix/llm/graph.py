"""Connected components by min-label propagation with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for every vertex of ``edges`` (a, b) the smallest id reachable.

    Each turn takes the smallest label among a vertex and its neighbours (summed up within tasks before the shuffle, so a
    vertex with very many edges is no hot key), then replaces the label by its own label. Turns grow with the logarithm
    of the longest chain. Only a count comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both, "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        step = step.join(up, step.label == up.up_id, "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = cut(step, "labels")
        labels = step.select("id", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
