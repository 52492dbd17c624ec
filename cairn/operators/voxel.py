"""Voxel down-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cloud, stats
from .session import clouds

AXES = ("x", "y", "z")


def voxels(df: DataFrame, leaf: float, key: str = "cell", by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with voxel coordinates hx, hy, hz and, for the linear keys, h.

    The linear keys number voxels row by row with the range over leaf as row length, whole (``linear_ceil``) or not
    (``linear_float``). They are kept for comparison: distinct voxels can share one; ``cell`` never mixes voxels.
    """
    by = clouds(df, by)
    out = cloud.same_cloud(df, stats.bounds(df, by), by)  # one row a cloud
    cell = {c: F.floor((F.col(c) - F.col(f"min_{c}")) / leaf) for c in AXES}
    rows = {c: (F.col(f"max_{c}") - F.col(f"min_{c}")) / leaf for c in AXES}
    out = out.withColumns({f"h{c}": v for c, v in cell.items()})
    if key != "cell":
        if key == "linear_ceil":
            rows = {c: F.ceil(v).cast("double") for c, v in rows.items()}
        h = F.floor(F.col("hx") + F.col("hy") * rows["x"] + F.col("hz") * rows["x"] * rows["y"])
        out = out.withColumn("h", h)
    return out.drop(*[f"{n}_{c}" for c in AXES for n in ("min", "max")])


def _keys(key: str) -> list[str]:
    return ["hx", "hy", "hz"] if key == "cell" else ["h"]


def voxel_filter(df: DataFrame, leaf: float, key: str = "cell", by: Sequence[str] | None = None) -> DataFrame:
    """Centroid and size of every occupied voxel; one shuffle, after partial sums."""
    by = clouds(df, by)
    grouped = voxels(df, leaf, key, by).groupBy(*by, *_keys(key))
    return grouped.agg(*[F.avg(c).alias(c) for c in AXES], F.count("*").alias("n_points"))


def sample_order(seed: int) -> Column:
    """A fixed shuffle of ids by modular arithmetic, the same in any SQL engine."""
    return F.pmod(F.pmod("point_id", F.lit(1000003)) * 7919 + 104729 * (seed + 1), F.lit(1000003))


def voxel_pick(df: DataFrame, leaf: float, key: str = "cell", seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """One member of every voxel, the first of a seeded shuffle."""
    by = clouds(df, by)
    order = F.struct(sample_order(seed), "point_id")
    by = clouds(df, by)
    grouped = voxels(df, leaf, key, by).groupBy(*by, *_keys(key))
    return grouped.agg(F.min_by(F.struct("point_id", *AXES), order).alias("p")).select(*by, *_keys(key), "p.*")


def runs(df: DataFrame, slot: Column, value: str, order: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """``slot`` and ``run``: within a slot a run ends where the value changes, in order of ``order``."""
    w = Window.partitionBy(*by, "slot").orderBy(order)
    df = df.withColumn("slot", slot)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def voxel_filter_hashed(df: DataFrame, leaf: float, slots: int = 200, by: Sequence[str] | None = None) -> DataFrame:
    """Bounded-memory down-sampling: points go to ``slots`` slots by voxel number, and a slot gives out its centroid whenever
    its voxel changes. Empty slots give nothing."""
    by = clouds(df, by)
    marked = runs(voxels(df, leaf, "linear_ceil", by), F.pmod("h", F.lit(slots)), "h", by=by)
    return marked.groupBy(*by, "slot", "run", "h").agg(*[F.avg(c).alias(c) for c in AXES], F.count("*").alias("n_points"))
