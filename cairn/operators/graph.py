"""Edge lists: connected components, symmetrised neighbour graphs, Laplacians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import clouds, cut


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """``node`` and ``label`` (the least node of its component); ``by`` holds graphs apart.

    Each round takes the least label among neighbours and then that label's own label, so the rounds follow the logarithm of
    the longest path. Lineage is cut every round; labels never leave the executors.
    """
    by = list(by)
    both = cut(edges.select(*by, "src", "dst").union(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(nodes.select(*by, F.col(node).alias("n")).distinct().withColumn("label", F.col("n")))
    while True:
        near = both.join(labels.withColumnRenamed("n", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*by, "n"], "left").select(*by, "n", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # as a sum the key is dealt anew on this side too, so that a label that many nodes have can be split
        far = step.where("label <> n").select(*by, (F.col("n") + F.lit(0)).alias("label"), F.col("label").alias("far"))
        step = cut(step.join(far, [*by, "label"], "left").select(*by, "n", F.coalesce("far", "label").alias("label"), (F.col("label") != F.col("was")).alias("moved")))
        labels = step.select(*by, "n", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("n", node)


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each once. What they come from is computed once: a union with themselves would do it again."""
    swap = {"src": "dst", "dst": "src"}
    both = F.array(F.struct(*edges.columns), F.struct(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns]))
    return edges.select(F.explode(both).alias("_e")).select(*[F.col(f"_e.{c}").alias(c) for c in edges.columns]).distinct()


def averaged(edges: DataFrame) -> DataFrame:
    """Half a unit for each direction in which an edge is listed."""
    by = clouds(edges)
    both = edges.select(*by, "src", "dst").union(edges.select(*by, "dst", "src"))
    return both.groupBy(*by, "src", "dst").agg((F.count("*") * 0.5).alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*clouds(edges), "src").agg(F.sum("w").alias("degree"))


def random_walk_laplacian(edges: DataFrame) -> DataFrame:
    """Off-diagonal and diagonal cells of I - D^-1 W."""
    by = clouds(edges)
    d = degree(edges)
    off = edges.join(d, [*by, "src"]).select(*by, "src", "dst", (-F.col("w") / F.col("degree")).alias("l"))
    return off.union(d.select(*by, "src", F.col("src").alias("dst"), F.lit(1.0).alias("l")))
