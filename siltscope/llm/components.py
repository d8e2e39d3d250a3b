"""Connected components of an edge table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id on an edge.

    Each round a node takes the smallest label among its neighbours and then its label's own label, so chains halve.
    A hub's edges are summed up before the shuffle. Rounds are written to the shared folder.
    """
    e = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = saved(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        seen = e.join(labels, e.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels.id == seen.a).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = saved(near.join(up, "label", "left").select("id", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = step.select("id", "label")
        if not step.filter("label <> was").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
