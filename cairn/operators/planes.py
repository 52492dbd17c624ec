"""Plane fits and ground removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import cloud, stats, voxel
from .session import clouds, cut

AXES = ("x", "y", "z")


def lsq_plane(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """a, b, c, d of each cloud's least-squares plane: the direction of least variance through the mean."""
    by = clouds(df, by)
    fit = cloud.same_cloud(stats.covariance(df, by), stats.mean(df, by), by)
    v = fit.withColumn("v", stats.eigenpairs(*[F.col(f"{a}{b}") for a, b in stats.UPPER])[2])
    a, b, c = (F.col("v")[k] for k in (1, 2, 3))
    return v.select(*by, a.alias("a"), b.alias("b"), c.alias("c"), (-(a * F.col("mean_x") + b * F.col("mean_y") + c * F.col("mean_z"))).alias("d"))


def hypotheses(df: DataFrame, n: int = 35, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """iter, unit normal and a point of planes through n triples of points of each cloud; triples without area are left out.

    Only the 3n first points of a cloud's shuffle are gathered.
    """
    by = clouds(df, by)
    picked = df.select(*by, voxel.sample_order(seed).alias("o"), "point_id", *AXES)
    if by:
        first = Window.partitionBy(*by).orderBy("o", "point_id")
        picked = picked.withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= 3 * n).drop("_first")
    else:
        picked = picked.orderBy("o", "point_id").limit(3 * n)
    at = picked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("o", "point_id", *AXES))).alias("p")).select(*by, F.posexplode("p").alias("k", "p"))
    rows = at.groupBy(*by, F.floor(F.col("k") / 3).cast("int").alias("iter")).agg(F.sort_array(F.collect_list(F.struct("k", "p.x", "p.y", "p.z"))).alias("t")).where(F.size("t") == 3)
    t = [tuple(F.col("t")[k][c] for c in AXES) for k in range(3)]
    m = g.cross(g.minus(t[1], t[0]), g.minus(t[2], t[0]))
    rows = rows.select(*by, "iter", *[x.alias(f"m{c}") for x, c in zip(m, AXES, strict=True)], *[x.alias(f"p{c}") for x, c in zip(t[0], AXES, strict=True)])
    length = g.norm(g.triple("mx", "my", "mz"))
    return rows.withColumn("len", length).where("len > 0").select(*by, "iter", *[(F.col(f"m{c}") / F.col("len")).alias(f"n{c}") for c in AXES], "px", "py", "pz")


PLANE = [f"{p}{c}" for p in "np" for c in AXES]


def ransac_scores(df: DataFrame, planes: DataFrame, tao: float = 0.2, by: Sequence[str] | None = None) -> DataFrame:
    """``planes`` with their inliers (strictly nearer than ``tao``) in their cloud.

    All planes are scored in one pass: every plane is one conditional count, so no point is copied. One cloud's planes are literals;
    those of many come to the points of each as one array.
    """
    by = clouds(df, by)
    if not by:
        found = planes.collect()  # as many as iterations were asked for
        if not found:
            return planes.withColumn("inliers", F.lit(0).cast("long"))
        lit = lambda r, p: tuple(F.lit(r[f"{p}{c}"]) for c in AXES)
        counts = [F.count(F.when(g.normal_distance(g.triple(), lit(r, "n"), lit(r, "p")) < tao, 1)) for r in found]
        row = df.agg(F.array(*counts).alias("c"), F.array(*[F.lit(r["iter"]) for r in found]).alias("i"))
        scored = row.select(F.explode(F.arrays_zip("c", "i")).alias("s")).select(F.col("s.i").alias("iter"), F.col("s.c").alias("inliers"))
        return planes.join(F.broadcast(scored), "iter")
    planes = cut(planes)
    most = planes.groupBy(*by).count().agg(F.max("count")).first()[0]  # as many as iterations were asked for
    if not most:
        return planes.withColumn("inliers", F.lit(0).cast("long"))
    listed = planes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("iter", *PLANE))).alias("h"))
    of = lambda k, p: tuple(F.get("h", F.lit(k))[f"{p}{c}"] for c in AXES)
    points = cloud.same_cloud(df.select(*by, *AXES), listed, by)
    counts = [F.count(F.when(g.normal_distance(g.triple(), of(k, "n"), of(k, "p")) < tao, 1)) for k in range(most)]
    row = cloud.same_cloud(points.groupBy(*by).agg(F.array(*counts).alias("c")), listed, by)
    scored = row.select(*by, F.posexplode("h").alias("k", "h"), "c").select(*by, F.col("h.iter").alias("iter"), F.get("c", F.col("k")).alias("inliers"))
    return planes.join(scored, [*by, "iter"])


def ransac_plane(df: DataFrame, tao: float = 0.2, max_iters: int = 35, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """nx..nz, px..pz, inliers of each cloud's best plane: the first of those with most inliers, if that is more than 2; else no row."""
    by = clouds(df, by)
    scored = ransac_scores(df, hypotheses(df, max_iters, seed, by), tao, by).where("inliers > 2")
    if not by:
        return scored.orderBy(F.desc("inliers"), "iter").limit(1)
    best = Window.partitionBy(*by).orderBy(F.desc("inliers"), "iter")
    return scored.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")


def ground_split(df: DataFrame, method: str = "ransac", tao: float = 0.2, max_iters: int = 35, seed: int = 0, fit_on: DataFrame | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with is_ground and plane_dist, by its cloud's plane. Methods: ransac, lsq, ransac_lsq (a least-squares plane through the first one's inliers).

    Without a plane nothing is ground. ``fit_on`` fits the planes to another table, such as a down-sampled cloud.
    """
    by = clouds(df, by)
    base = df if fit_on is None else fit_on

    def split(points: DataFrame, fitted: DataFrame, distance: Column, named: Sequence[str]) -> DataFrame:
        near = cloud.beside(points, fitted.select(*by, *[F.col(c).alias(f"_{c}") for c in named]), by, "left")
        return near.withColumn("plane_dist", distance).withColumn("is_ground", F.coalesce(F.col("plane_dist") < tao, F.lit(False))).drop(*[f"_{c}" for c in named])

    if method in ("ransac", "ransac_lsq"):
        plane = ransac_plane(base, tao, max_iters, seed, by)
        plane = cut(plane) if by else plane
        away = g.normal_distance(g.triple(), *[tuple(F.col(f"_{p}{c}") for c in AXES) for p in "np"])
        if method == "ransac":
            return split(df, plane, away, PLANE)
        base = split(base, plane, away, PLANE).where("is_ground").select(*base.columns)
    elif method != "lsq":
        raise ValueError(f"unknown method {method!r}")
    p = lsq_plane(base, by)
    p = cut(p) if by else p
    return split(df, p, g.plane_distance(g.triple(), *[F.col(f"_{c}") for c in "abcd"]), "abcd")


def ground_passes(df: DataFrame, leaf: float = 1.0, tao: float = 0.2, max_iters: int = 35, seeds: Sequence[int] = (0, 1), by: Sequence[str] | None = None) -> DataFrame:
    """Down-sample, then for each seed fit a plane to each cloud's sample and classify the whole cloud; the passes are stacked, so points come twice."""
    by = clouds(df, by)
    sample = cut(voxel.voxel_filter(df, leaf, by=by).select(*by, ((F.col("hx") * 2**21 + F.col("hy")) * 2**21 + F.col("hz")).alias("point_id"), *AXES))
    return cloud.stack(*[ground_split(df, "ransac", tao, max_iters, s, fit_on=sample, by=by) for s in seeds], tag="pass")
