"""Seeded synthetic point sets. Numbers come from row ids by modular arithmetic, so any partitioning gives the same points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PRIME = 2**31 - 1


def uniform(seed: int, stream: int) -> Column:
    """In (0, 1), from the column ``point_id``: a linear and two quadratic steps modulo a prime, the same in any SQL engine."""
    h = F.pmod(F.pmod("point_id", F.lit(PRIME)) * 48271 + (stream * 69621 + seed * 16807 + 12345), F.lit(PRIME))
    for factor in (48271, 69621):
        h = F.pmod(h * h + h * factor + 11, F.lit(PRIME))
    return (h.cast("double") + 0.5) / float(PRIME)


def gaussian(seed: int, stream: int) -> Column:
    return F.sqrt(-2.0 * F.log(uniform(seed, 2 * stream))) * F.cos(2.0 * math.pi * uniform(seed, 2 * stream + 1))


def _points(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "point_id")


def cube(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _points(spark, n).select("point_id", *[uniform(seed, 10 + k).alias(c) for k, c in enumerate("xyz")])


def gaussians(spark: SparkSession, sizes: Sequence[int] = (400, 600, 1000), means: Sequence[Sequence[float]] = ((0.5, 0.5), (5.5, 2.5), (1.0, 7.0)), variances: Sequence[Sequence[float]] = ((1.0, 3.0), (2.0, 2.0), (6.0, 2.0)), seed: int = 0) -> DataFrame:
    """point_id, x, y, component: blocks of rows from Gaussians with diagonal covariance."""
    edges = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    comp = sum(((F.col("point_id") >= e).cast("int") for e in edges[2:-1]), (F.col("point_id") >= edges[1]).cast("int")) if len(sizes) > 1 else F.lit(0)
    pick = lambda rows, axis: F.element_at(F.array(*[F.lit(float(r[axis])) for r in rows]), F.col("component") + 1)
    df = _points(spark, edges[-1]).withColumn("component", comp)
    return df.select("point_id", *[(gaussian(seed, k) * F.sqrt(pick(variances, k)) + pick(means, k)).alias(c) for k, c in enumerate("xy")], "component")


def shapes(spark: SparkSession, kind: str, n: int = 1500, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """point_id, x, y, part of one of the six comparison sets: circles, moons, blobs, uniform, sheared, varied."""
    df, half = _points(spark, n), n // 2
    part = (F.col("point_id") >= half).cast("int")
    t = F.when(part == 0, F.col("point_id") / half).otherwise((F.col("point_id") - half) / (n - half))
    e = [gaussian(seed, k) * noise for k in (0, 1)]
    if kind == "circles":
        radius, angle = F.when(part == 0, 1.0).otherwise(0.5), t * 2.0 * math.pi
        return df.select("point_id", (radius * F.cos(angle) + e[0]).alias("x"), (radius * F.sin(angle) + e[1]).alias("y"), part.alias("part"))
    if kind == "moons":
        a = t * math.pi
        x = F.when(part == 0, F.cos(a)).otherwise(1.0 - F.cos(a))
        y = F.when(part == 0, F.sin(a)).otherwise(0.5 - F.sin(a))
        return df.select("point_id", (x + e[0]).alias("x"), (y + e[1]).alias("y"), part.alias("part"))
    if kind == "uniform":
        return df.select("point_id", uniform(seed, 10).alias("x"), uniform(seed, 11).alias("y"), F.lit(0).alias("part"))
    deviations = (1.0, 2.5, 0.5) if kind == "varied" else (1.0, 1.0, 1.0)
    if kind not in ("blobs", "sheared", "varied"):
        raise ValueError(f"unknown set {kind!r}")
    which = F.pmod("point_id", F.lit(3)).cast("int")
    centres = [(-7.0, -4.0), (2.0, 6.0), (7.0, -6.0)]
    at = lambda rows: F.element_at(F.array(*[F.lit(float(v)) for v in rows]), which + 1)
    x = gaussian(seed, 0) * at(deviations) + at([c[0] for c in centres])
    y = gaussian(seed, 1) * at(deviations) + at([c[1] for c in centres])
    out = df.select("point_id", x.alias("x"), y.alias("y"), which.alias("part"))
    if kind == "sheared":
        from ..operators.cloud import transform

        return transform(out, [[0.6, -0.6], [-0.4, 0.8]])
    return out


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows drawn with replacement from a table with dense ids 0..m-1; ``draw`` numbers them."""
    m = df.count()
    draws = df.sparkSession.range(n).withColumnRenamed("id", "point_id").select(F.col("point_id").alias("draw"), F.floor(uniform(seed, 0) * m).cast("long").alias("point_id"))
    return draws.join(df, "point_id") if m else df.withColumn("draw", F.lit(0).cast("long")).limit(0)
