"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round takes the least label among the neighbours and then follows that
    label's own label, so that paths halve; each round is a written table. Hot
    nodes meet only partial aggregates and equi-joins that Spark can split.
    Null ends are dropped; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = written(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels-0")
    for k in range(1, most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        step = step.join(jump, F.col("label") == F.col("j"), "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        step = written(step, f"labels-{k}")
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
