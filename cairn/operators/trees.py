"""Leaves of space partitions, as tables: path, depth, size and place. Searches don't use them; they report structure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g
from . import cloud, stats
from .session import clouds, cut

AXES = ("x", "y", "z")


def morton_paths(df: DataFrame, levels: int, by: Sequence[str] | None = None) -> DataFrame:
    """``path``: one octant digit a level, from its cloud's root cube down (above the centre is the upper half)."""
    by = clouds(df, by)
    out = cloud.same_cloud(df, stats.root_box(df, by), by)
    for _ in range(levels):
        child = g.octant(g.triple(), g.triple("cx", "cy", "cz"))
        path = F.concat(F.col("path"), child.cast("string")) if "path" in out.columns else child.cast("string")
        side = {f"c{c}": F.col(f"c{c}") + F.when(F.col(c) > F.col(f"c{c}"), F.col("half") / 2.0).otherwise(-F.col("half") / 2.0) for c in AXES}
        out = out.withColumns({"path": path, **side, "half": F.col("half") / 2.0})
    if "path" not in out.columns:
        out = out.withColumn("path", F.lit(""))
    return out


def octree_leaves(df: DataFrame, leaf_size: int, min_extent: float = 1e-4, by: Sequence[str] | None = None) -> DataFrame:
    """path, depth, n_points of every leaf: an octant is split while it has more than ``leaf_size`` points and a half side above ``min_extent``.

    No level loop: points are counted in the deepest octants, those counts at all their prefixes at once, and a leaf is a small enough octant
    whose parent isn't.
    """
    by = clouds(df, by)
    most = stats.root_box(df, by).agg(F.max("half")).first()[0]
    if most is None:
        return df.limit(0).select(*by, F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n_points"))
    levels = max(0, math.ceil(math.log2(most / min_extent))) if most > min_extent else 0
    own = F.greatest(F.ceil(F.log2(F.col("top") / min_extent)), F.lit(0)).cast("int")  # a smaller cloud has fewer
    deep = morton_paths(df, levels, by).select(*by, "path", (F.col("half") * 2.0**levels).alias("half")).groupBy(*by, "path").agg(F.count("*").alias("n"), F.first("half").alias("top"))
    deep = deep.withColumn("levels", F.when(F.col("top") > min_extent, own).otherwise(0))
    prefixes = deep.select(*by, "n", "levels", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("depth"), "path")
    counts = prefixes.groupBy(*by, F.substring("path", F.lit(1), F.col("depth")).alias("path"), "depth", "levels").agg(F.sum("n").alias("n_points"))
    split = counts.where((F.col("n_points") > leaf_size) & (F.col("depth") < F.col("levels"))).select(*by, F.col("path").alias("up"))
    leaves = counts.withColumn("up", F.col("path")).join(split, [*by, "up"], "left_anti")
    parent = leaves.withColumn("up", F.when(F.col("depth") > 0, F.substring("path", F.lit(1), F.col("depth") - 1)))
    found = parent.join(split, [*by, "up"], "left_semi").unionByName(parent.where("depth = 0"))
    return found.select(*by, "path", F.col("depth").cast("int").alias("depth"), "n_points")


def _subtree(leaf_size: int, split: str, columns: list[str]):
    """A node's whole subtree, for nodes that fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, first, out = pdf[list(AXES)].to_numpy(float), pdf.iloc[0], []
        axis, value = (None if pd.isna(first[c]) else first[c] for c in ("axis", "value"))
        todo = [(np.arange(len(m)), first["path"], axis, value, int(first["turn"]))]
        while todo:
            at, path, axis, value, turn = todo.pop()
            for a in [(turn + k) % 3 for k in range(3)] if len(at) > leaf_size else []:
                v = np.sort(m[at, a])
                low = v[(len(v) - 1) // 2]
                if low < v[-1]:
                    if split == "mean":
                        low = (low + v[np.searchsorted(v, low, "right")]) / 2.0
                    left = m[at, a] <= low
                    todo += [(at[left], path + "0", a, low, (a + 1) % 3), (at[~left], path + "1", a, low, (a + 1) % 3)]
                    break
            else:
                out.append((*[first[c] for c in columns], path, len(at), axis, value))
        return pd.DataFrame(out, columns=[*columns, "path", "n_points", "axis", "value"]).astype({"axis": "Int32", "value": "float64"})

    return run


def kdtree_leaves(df: DataFrame, leaf_size: int, split: str = "median", by: Sequence[str] | None = None, task: int = 100_000) -> DataFrame:
    """path, depth, n_points, and axis and value of the last split, of every leaf.

    Axes take turns; ``median`` splits at the lower median (equal values go left), ``mean`` halfway between it and the
    element after. A node that its axis can't split, as none of its points lie above the median there, is tried on the next axis; it is a leaf
    once no axis splits it. Nodes of more than ``task`` points are split level by level, their medians found by dense positions in a sort by range, so no
    task holds one; a smaller node's subtree is built by one task. Levels go on until only leaves are left.
    """
    by = clouds(df, by)
    node = [*by, "path"]
    todo = df.select(*by, "point_id", *AXES).withColumns({"path": F.lit(""), "axis": F.lit(None).cast("int"), "value": F.lit(None).cast("double"), "turn": F.lit(0), "stuck": F.lit(0)})
    leaf = StructType([*[df.schema[c] for c in by], *StructType.fromDDL("path string, n_points long, axis int, value double").fields])
    small, done = [], []
    while True:
        counts = cut(todo.groupBy(*node).agg(F.count("*").alias("n")))
        big = counts.where(F.col("n") > task).select(*node, "n")
        if big.isEmpty():
            small.append(todo)
            break
        small.append(todo.join(big, node, "left_anti"))
        along = todo.join(big, node).withColumn("_v", F.element_at(F.array(*AXES), F.col("turn") + 1))
        placed = cloud.reindex(along, ["_v"], "_at", node)
        ends = placed.where((F.col("_at") == F.floor((F.col("n") - 1) / 2)) | (F.col("_at") == F.col("n") - 1)).groupBy(*node).agg(F.min("_v").alias("low"), F.max("_v").alias("top"))
        if split == "mean":
            above = cloud.same_cloud(placed, ends, node).where(F.col("_v") > F.col("low")).groupBy(*node).agg(F.min("_v").alias("next"))
            ends = ends.join(above, node, "left").withColumn("low", F.when(F.col("next").isNotNull(), (F.col("low") + F.col("next")) / 2.0).otherwise(F.col("low"))).drop("next")
        splits = F.col("low") < F.col("top")
        told = placed.join(ends, node)
        moved = told.select(
            *by, "point_id", *AXES, F.when(splits, F.concat("path", F.when(F.col("_v") <= F.col("low"), "0").otherwise("1"))).otherwise(F.col("path")).alias("path"),
            F.when(splits, F.col("turn")).otherwise(F.col("axis")).alias("axis"), F.when(splits, F.col("low")).otherwise(F.col("value")).alias("value"), ((F.col("turn") + 1) % 3).alias("turn"), F.when(splits, 0).otherwise(F.col("stuck") + 1).alias("stuck"),
        )
        moved = cut(moved)
        done.append(moved.where("stuck >= 3").groupBy(*node).agg(F.count("*").alias("n_points"), F.first("axis").alias("axis"), F.first("value").alias("value")))
        todo = moved.where("stuck < 3")
    rest = reduce(DataFrame.unionByName, small).groupBy(*node).applyInPandas(_subtree(leaf_size, split, by), leaf)
    out = reduce(DataFrame.unionByName, [rest, *done])
    return out.select(*by, "path", F.length("path").alias("depth"), "n_points", "axis", "value")


def depth(leaves: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Levels of the tree and its number of leaves, by cloud."""
    return leaves.groupBy(*clouds(leaves, by)).agg((F.max("depth") + 1).cast("int").alias("levels"), F.count("*").alias("leaves"))
