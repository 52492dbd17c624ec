"""Surface normals, salient points and local descriptors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import cloud, neighbors, stats
from .session import clouds, cut

AXES = ("x", "y", "z")


def normals(points: DataFrame, k: int = 200, r: float | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """point_id, nx, ny, nz: the direction of least variance among the k nearest points (or those within r), itself included.

    Neighbours carry their coordinates and are dealt by query already, so moments need no further shuffle; one LAPACK call per Arrow batch
    gives the vectors. A point without a neighbourhood of two has no row.
    """
    by = clouds(points, by)
    if r is None:
        pairs = neighbors.knn_join(points, points, k, by=by, carry=AXES)
    else:
        pairs = neighbors.radius_join(points, points, r, by=by, carry=AXES)
    m = stats.covariance(pairs.select(*by, "query_id", *[F.col(f"n_{c}").alias(c) for c in AXES]), [*by, "query_id"]).where("xx is not null")
    v = m.select(*by, F.col("query_id").alias("point_id"), stats.eigenpairs(*[F.col(f"{a}{b}") for a, b in stats.UPPER])[2].alias("v"))
    return v.select(*by, "point_id", *[F.col("v")[k].alias(n) for k, n in ((1, "nx"), (2, "ny"), (3, "nz"))])


# --- salient points -------------------------------------------------------


def weighted_scatter(points: DataFrame, r: float, by: Sequence[str] | None = None) -> DataFrame:
    """Scatter of each point's neighbours about it, a neighbour weighing one over its own neighbour count.

    The pairs are joined twice, once for the counts and once for the sums, and summed where they arise: none is written.
    """
    by = clouds(points, by)
    counts = cut(neighbors.radius_count(points, r, by))
    weighed = cloud.same_cloud(points.select(*by, "point_id", *AXES), counts.select(*by, "point_id", (1.0 / F.col("n")).alias("w")), [*by, "point_id"])
    pairs = neighbors.radius_join(points, weighed, r, by=by, carry=(*AXES, "w"))
    d = {c: F.col(f"n_{c}") - F.col(f"q_{c}") for c in AXES}
    w = F.col("n_w")
    return pairs.groupBy(*by, F.col("query_id").alias("point_id")).agg(*[(F.sum(w * d[a] * d[b]) / F.sum(w)).alias(f"{a}{b}") for a, b in stats.UPPER])


def salient(points: DataFrame, r: float, ratio: float = 0.875, by: Sequence[str] | None = None) -> DataFrame:
    """point_id, l1, l2, l3 where each eigenvalue is clearly below the one before; the score is l3."""
    by = clouds(points, by)
    e = stats.scatter_eigenvalues(weighted_scatter(points, r, by), [*by, "point_id"])
    return e.where((F.col("l1") * ratio > F.col("l2")) & (F.col("l2") * ratio > F.col("l3")))


def _skipping(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cloud's points by a walk that takes the best and removes what conflicts with it from the list it walks over: the entry after
    each removed one isn't tested in that round."""
    score = dict(zip(pdf["point_id"], pdf["score"], strict=True))
    foes = {p: set(map(int, f)) for p, f in zip(pdf["point_id"], pdf["foes"], strict=True)}
    left = sorted(score, key=lambda p: (score[p], p))
    kept = []
    while left:
        best = left.pop()
        kept.append(best)
        at = 0
        while at < len(left):
            if left[at] in foes[best]:
                del left[at]
            at += 1
    return pdf.set_index("point_id").loc[kept].reset_index().drop(columns=["foes", "_all"])


def _best_apart(good: DataFrame, close, by: list[str]) -> DataFrame:
    """Greedy choice by falling (score, id): in rounds, what beats all that conflicts with it stays and those go; as a walk would have it.

    ``close(a, b)`` joins what conflicts. It is joined anew for each question, and only answers by point leave the task that finds a pair.
    """
    key = [*by, "point_id"]
    left, kept = cut(good), []
    beats = (F.col("n_score") > F.col("q_score")) | ((F.col("n_score") == F.col("q_score")) & (F.col("neighbor_id") > F.col("query_id")))
    while not left.isEmpty():
        beaten = close(left, left).where(beats).select(*by, F.col("query_id").alias("point_id")).distinct()
        stay = cut(left.join(beaten, key, "left_anti"))
        kept.append(stay)
        gone = close(stay, left).select(*by, F.col("neighbor_id").alias("point_id")).union(stay.select(*key)).distinct()
        left = cut(left.join(gone, key, "left_anti"))
    return reduce(DataFrame.union, kept, good.limit(0))


def iss_keypoints(points: DataFrame, r: float = 0.2, threshold: float = 0.4, compat_skip: bool = False, by: Sequence[str] | None = None) -> DataFrame:
    """point_id, score, order (from 1, in its cloud): salient points that no better one overlaps by more than ``threshold`` (balls of radius r).

    Overlap above a threshold is distance below one, so conflicts are a radius join. With ``compat_skip`` a cloud's salient points are one
    sequential group, as skipping depends on the whole list.
    """
    by = clouds(points, by)
    good = cut(salient(points, r, by=by).select(*by, "point_id", F.col("l3").alias("score")))
    reach = g.iou_radius(r, threshold)
    placed = points.select(*by, "point_id", *AXES).join(good, [*by, "point_id"])

    def close(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = neighbors.radius_join(a, b, reach, exclude_self=True, by=by, carry=["score"])
        return pairs.where(g.sphere_iou(F.col("dist"), r) > threshold)

    if compat_skip:
        foes = close(placed, placed).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.collect_list("neighbor_id").alias("foes"))
        rows = good.join(foes, [*by, "point_id"], "left").withColumn("foes", F.coalesce("foes", F.array().cast("array<bigint>")))
        kept = rows.withColumn("_all", F.lit(0)).groupBy(*by, "_all").applyInPandas(_skipping, good.schema)
    else:
        kept = _best_apart(placed, close, by).select(*good.columns)
    return cloud.reindex(kept, [F.desc("score"), F.desc("point_id")], "order", by).withColumn("order", (F.col("order") + 1).cast("int"))


# --- descriptors ----------------------------------------------------------


def pair_angles(points: DataFrame, r: float, ids: DataFrame | None = None, alpha: str = "published", by: Sequence[str] | None = None) -> DataFrame:
    """query_id, neighbor_id, dist, alpha, phi, theta of each point and its other neighbours within r (points need nx, ny, nz).

    Coincident neighbours have no direction and are left out. ``alpha='degenerate'`` is 0 throughout.
    """
    by = clouds(points, by)
    asked = points if ids is None else points.join(ids.select(*by, "point_id"), [*by, "point_id"], "left_semi")
    pairs = neighbors.radius_join(asked, points, r, exclude_self=True, by=by, carry=(*AXES, "nx", "ny", "nz")).where("dist > 0")
    u, other = g.triple("q_nx", "q_ny", "q_nz"), g.triple("n_nx", "n_ny", "n_nz")
    d = tuple((F.col(f"n_{c}") - F.col(f"q_{c}")) / F.col("dist") for c in AXES)
    pairs = pairs.withColumns({f"_d{c}": x for c, x in zip(AXES, d, strict=True)})
    d = g.triple("_dx", "_dy", "_dz")
    pairs = pairs.withColumns({f"_v{c}": x for c, x in zip(AXES, g.cross(u, d), strict=True)})
    v = g.triple("_vx", "_vy", "_vz")
    w = g.cross(u, v)
    return pairs.select(*by, "query_id", "neighbor_id", "dist", (g.dot(v, other) if alpha == "published" else F.lit(0.0)).alias("alpha"), g.dot(u, d).alias("phi"), F.atan2(g.dot(w, other), g.dot(u, other)).alias("theta"))


def spfh(points: DataFrame, r: float = 0.2, bins: int = 6, ids: DataFrame | None = None, alpha: str = "published", by: Sequence[str] | None = None) -> DataFrame:
    """point_id, feature: three normalised histograms of ``bins`` bins. A point without neighbours has no row.

    All 3 * bins counts are conditional sums of one grouping. Rounding may leave a cosine a hair outside [-1, 1]; as
    in the definition it is then in no bin. A histogram without entries is 0.
    """
    by = clouds(points, by)
    return _histograms(pair_angles(points, r, ids, alpha, by), bins, by)


def _histograms(a: DataFrame, bins: int, by: list[str]) -> DataFrame:
    ranges = (("alpha", -1.0, 1.0), ("phi", -1.0, 1.0), ("theta", -math.pi, math.pi))
    counts = [F.count(F.when(g.bin_of(F.col(c), lo, hi, bins) == b, 1)).cast("double").alias(f"{c}{b}") for c, lo, hi in ranges for b in range(bins)]
    h = a.groupBy(*by, F.col("query_id").alias("point_id")).agg(*counts)
    cells = []
    for c, _, _ in ranges:
        total = sum((F.col(f"{c}{b}") for b in range(1, bins)), F.col(f"{c}0"))
        cells += [F.when(total > 0, F.col(f"{c}{b}") / total).otherwise(0.0) for b in range(bins)]
    return h.select(*by, "point_id", F.array(*cells).alias("feature"))


def fpfh(points: DataFrame, r: float = 0.2, bins: int = 6, ids: DataFrame | None = None, alpha: str = "published", by: Sequence[str] | None = None) -> DataFrame:
    """point_id, feature: own histogram plus the mean of the neighbours', weighed by 1 / distance; unit length.

    Histograms are computed once for every point that is asked for or near one; a second join of the neighbours carries them, and pairs are
    summed where they arise: none is written. The mean is over one less than the neighbours counted with the point itself. Isolated points have no row.
    """
    by = clouds(points, by)
    asked = near_asked = None
    if ids is not None:
        asked = ids.select(*by, "point_id")
        found = neighbors.radius_join(points.join(asked, [*by, "point_id"], "left_semi"), points, r, exclude_self=True, by=by).where("dist > 0")
        near_asked = found.select(*by, F.col("neighbor_id").alias("point_id")).union(asked).distinct()
    simple = cut(spfh(points, r, bins, near_asked, alpha, by))
    n = 3 * bins
    queries = points if asked is None else points.join(asked, [*by, "point_id"], "left_semi")
    told = points.select(*by, "point_id", *AXES).join(simple, [*by, "point_id"])
    near = neighbors.radius_join(queries, told, r, exclude_self=True, by=by, carry=["feature"]).where("dist > 0")
    sums = near.groupBy(*by, "query_id").agg(F.count("*").alias("_n"), *[F.sum(F.col("n_feature")[k] / F.col("dist")).alias(f"_s{k}") for k in range(n)])
    both = sums.join(simple.withColumnRenamed("point_id", "query_id"), [*by, "query_id"])
    raw = both.select(*by, F.col("query_id").alias("point_id"), F.array(*[F.col("feature")[k] + F.col(f"_s{k}") / F.col("_n") for k in range(n)]).alias("f"))
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda t, x: t + x * x))
    return raw.withColumn("_l", length).select(*by, "point_id", F.transform("f", lambda x: x / F.col("_l")).alias("feature"))


def descriptor_rows(described: DataFrame) -> DataFrame:
    """The long form: key_idx, index, feature."""
    return described.select(*clouds(described), F.col("point_id").alias("key_idx"), F.posexplode("feature").alias("index", "feature"))


def describe(points: DataFrame, keypoints: DataFrame, r: float = 0.2, bins: int = 6, height: float = 0.2, alpha: str = "published") -> DataFrame:
    """Descriptors, in long form, of the key points that lie in the low slab of their cloud."""
    inside = cloud.gather(cloud.low_slab(points, height), keypoints).select(*clouds(points), "point_id")
    return descriptor_rows(fpfh(points, r, bins, inside, alpha))
