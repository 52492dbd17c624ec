"""Aggregates over point tables: all of them partial and final hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import geometry as g

AXES = ("x", "y", "z")
UPPER = [(a, b) for k, a in enumerate(AXES) for b in AXES[k:]]


def bounds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))])


def root_box(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cube that an octree starts from: half side of the longest range, placed at the least corner."""
    b = bounds(df, by)
    half = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES]) / 2.0
    return b.withColumn("half", half).select(*by, *[(F.col(f"min_{c}") + F.col("half")).alias(f"c{c}") for c in AXES], "half")


def mean(df: DataFrame, by: Sequence[str] = (), cols: Sequence[str] = AXES) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def covariance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Upper triangle with n - 1, one row a group."""
    return df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"{a}{b}") for a, b in UPPER])


def correlation(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.corr(a, b).alias(f"{a}{b}") for a, b in UPPER])


def weighted(df: DataFrame, weight: str, by: Sequence[str] = (), cols: Sequence[str] = AXES) -> DataFrame:
    """Weighted mean and weighted variance about it."""
    w = F.col(weight)
    sums = df.groupBy(*by).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s_{c}") for c in cols], *[F.sum(w * F.col(c) * F.col(c)).alias(f"_q_{c}") for c in cols])
    m = [F.col(f"_s_{c}") / F.col("_w") for c in cols]
    return sums.select(*by, F.col("_w").alias("weight"), *[x.alias(f"mean_{c}") for x, c in zip(m, cols, strict=True)], *[F.greatest(F.col(f"_q_{c}") / F.col("_w") - x * x, F.lit(0.0)).alias(f"var_{c}") for x, c in zip(m, cols, strict=True)])


def scatter_eigenvalues(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``l1 >= l2 >= l3`` of the matrix in columns xx .. zz, closed form."""
    l1, l2, l3 = g.eigenvalues(*[F.col(f"{a}{b}") for a, b in UPPER])
    return df.select(*keep, l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def eigenpairs(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Rows (value, vx, vy, vz), largest value first; each vector's largest component is positive.

    One call of LAPACK for a whole Arrow batch of matrices; it also holds for equal eigenvalues, where closed-form
    vectors don't. Matrices with missing cells give null.
    """
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float)
    ok = np.isfinite(m).all(axis=(1, 2))
    out = np.full(len(m), None, dtype=object)
    if ok.any():
        values, vectors = np.linalg.eigh(m[ok])
        values, vectors = values[:, ::-1], np.swapaxes(vectors[:, :, ::-1], 1, 2)
        big = np.take_along_axis(vectors, np.abs(np.round(vectors, 12)).argmax(axis=2)[..., None], 2)
        rows = np.concatenate([values[..., None], vectors * np.where(big < 0, -1.0, 1.0)], axis=2)
        for k, r in zip(np.flatnonzero(ok), rows, strict=True):
            out[k] = r.tolist()
    return pd.Series(out)


def pca(df: DataFrame, correlation_matrix: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One row a component, the largest first: component (from 1), eigenvalue, vx, vy, vz."""
    m = (correlation if correlation_matrix else covariance)(df, by)
    pairs = m.select(*by, F.posexplode(eigenpairs(*[F.col(f"{a}{b}") for a, b in UPPER])).alias("k", "v"))
    return pairs.select(*by, (F.col("k") + 1).alias("component"), *[F.col("v")[k].alias(n) for k, n in enumerate(("eigenvalue", "vx", "vy", "vz"))])


def pca_project(df: DataFrame, components: DataFrame, k: int) -> DataFrame:
    """Coordinates p1..pk along the first k components, and the point rebuilt from them (rx, ry, rz)."""
    rows = components.where(F.col("component") <= k).orderBy("component").collect()  # at most three
    out = df
    for r in rows:
        out = out.withColumn(f"p{r['component']}", g.dot(g.triple(), tuple(F.lit(r[v]) for v in ("vx", "vy", "vz"))))
    back = {f"r{c}": sum((F.col(f"p{r['component']}") * F.lit(r[f"v{c}"]) for r in rows[1:]), F.col(f"p{rows[0]['component']}") * F.lit(rows[0][f"v{c}"])) for c in AXES}
    return out.withColumns(back)


def lower_median(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """The element of rank ceil(n / 2)."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col})").alias("median"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """bin, n and share of each occupied bin; values outside the range are left out."""
    binned = df.select(*by, g.bin_of(value, lo, hi, bins).alias("bin")).where("bin is not null")
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by) if by else None
    if whole is None:
        return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_t")))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
