"""Connected components by smallest label, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.llm.store import saved


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node of ``edges`` (``u``, ``v``).

    In a round each node takes the smallest label among its neighbours, then the label of its label; chains
    shrink to a logarithm of their length. Minima are combined before the shuffle, and joins read
    written tables, so a node with very many neighbours can be split.
    """
    both = saved(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component")), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("least"))
        lower = saved(labels.join(near, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before")), "labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = saved(lower.join(jump, "component").select("id", F.col("root").alias("component"), F.col("before")), "labels")
        if not labels.filter("component < before").limit(1).count():
            return labels.select("id", "component")
