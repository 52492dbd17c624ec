"""Connected components by least labels with pointer jumping; labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for every node of ``edges`` (a, b); a kept table."""
    both = common.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = common.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "cc")
    while True:
        # every node takes the least label around it, then that label's own label; kept in between, so that both sides
        # of the second join are dealt anew and a label that many nodes have can be split
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = common.keep(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "cc-step")
        common.drop(labels)
        changed = step.where("label <> was")
        if changed.isEmpty():
            common.drop(both)
            out = step.select("node", "label")
            out.kept_at = step.kept_at
            return out
        # a label points to its own label; only labels that have moved further need the jump
        jump = common.keep(step.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("far")).join(step.select("label").distinct(), "label", "left_semi"), "cc-jump")
        labels = common.keep(step.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "cc")
        common.drop(step, jump)
