"""Projections, filters, gathers and set operations on point tables (point_id, x, y, z, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import stats
from .session import clouds, cut


def project(df: DataFrame, *extra: str) -> DataFrame:
    """Identity and coordinates, as doubles."""
    return df.select(*clouds(df), "point_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")], *extra)


def reindex(df: DataFrame, order: Sequence[str | Column], name: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """Dense positions from 0 in the given order, within each group of ``by``, without sorting everything in one task.

    Rows are dealt by range; a row's position is its rank within its range plus the sizes of the ranges before. Ranks and ranges are kept
    before sizes are taken, as another run of the same plan may deal rows otherwise.
    """
    keys = [*map(F.col, by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranked = cut(dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*keys))))
    sizes = ranked.groupBy(*by, "_range").agg(F.count("*").alias("_n"))  # one row a partition, and one more for each group
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return same_cloud(ranked, before, [*by, "_range"]).withColumn(name, F.col("_rank") + F.col("_before") - 1).drop("_range", "_rank", "_before")


def same_cloud(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``by`` (nulls are equal); with no columns, with its one row."""
    if not by:
        return left.join(F.broadcast(right), how=how) if how != "left" else left.join(F.broadcast(right), F.lit(True), "left")
    other = right.withColumnsRenamed({c: f"_same_{c}" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by])
    return left.join(other, on, how).drop(*[f"_same_{c}" for c in by])


def beside(df: DataFrame, one: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of its cloud's row in the small table ``one``; with no ``by`` they are constants in the plan."""
    if by:
        return same_cloud(df, one, by, how)
    row = one.first()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in one.schema})


def gather(df: DataFrame, ids: DataFrame, unique: bool = True) -> DataFrame:
    """Rows of the given ids (of the given clouds, if the ids name them); with ``unique`` false, once for each time an id is listed."""
    keys = ["point_id", *(c for c in clouds(ids) if c in df.columns)]
    return df.join(ids.select(*keys), keys, "left_semi" if unique else "inner")


def box(df: DataFrame, lo: Sequence[float | None], hi: Sequence[float | None]) -> DataFrame:
    """Points within an axis-aligned box, borders included; None leaves a side open."""
    for c, a, b in zip(("x", "y", "z"), lo, hi, strict=True):
        df = df.where(F.col(c) >= F.lit(a)) if a is not None else df
        df = df.where(F.col(c) <= F.lit(b)) if b is not None else df
    return df


crop = box


def low_slab(df: DataFrame, height: float = 0.2, by: Sequence[str] | None = None) -> DataFrame:
    """The region of interest of descriptor runs: y and z at most ``height`` above their least value in the cloud."""
    by = clouds(df, by)
    edge = stats.bounds(df, by).select(*by, "min_y", "min_z")  # one row a cloud
    return same_cloud(df, edge, by).where((F.col("y") <= F.col("min_y") + height) & (F.col("z") <= F.col("min_z") + height)).drop("min_y", "min_z")


def standardize(df: DataFrame, cols: Sequence[str] = ("x", "y", "z"), by: Sequence[str] | None = None) -> DataFrame:
    """Zero mean and unit population deviation of each cloud; a constant column becomes 0."""
    by = clouds(df, by)
    out = same_cloud(df, df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]), by)
    for c in cols:
        s = F.col(f"_s_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(s == 0, 1.0).otherwise(s))
    return out.select(*df.columns)


def centre(df: DataFrame, cols: Sequence[str] = ("x", "y", "z"), by: Sequence[str] | None = None) -> DataFrame:
    by = clouds(df, by)
    out = same_cloud(df, df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]), by)
    return out.select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def transform(df: DataFrame, matrix: Sequence[Sequence[float]], cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows times a matrix."""
    new = {c: reduce(lambda a, b: a + b, [F.col(r) * F.lit(float(row[k])) for r, row in zip(cols, matrix, strict=True)]) for k, c in enumerate(cols)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def split_by_plane(df: DataFrame, normal: Sequence[float], through: Sequence[float], tao: float) -> DataFrame:
    """``plane_dist`` and ``is_ground`` (strictly nearer than ``tao``) against one plane."""
    d = g.normal_distance(g.triple(), tuple(map(F.lit, map(float, normal))), tuple(map(F.lit, map(float, through))))
    return df.withColumn("plane_dist", d).withColumn("is_ground", F.coalesce(F.col("plane_dist") < tao, F.lit(False)))


def stack(*parts: DataFrame, tag: str | None = None) -> DataFrame:
    """Bag union by column name; ``tag`` numbers the parts."""
    if tag:
        parts = [p.withColumn(tag, F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)
