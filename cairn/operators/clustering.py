"""Clustering of point tables. Models (k rows of d numbers) live on the driver, points never do."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import cloud, graph, neighbors
from .session import clouds, cut

AXES = ("x", "y", "z")


@dataclass
class Model:
    """What a fit found; ``predict`` adds a ``cluster`` column."""

    cols: list[str]
    centers: list[list[float]]
    iterations: int = 0
    weights: list[float] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        cols = [F.col(c) for c in self.cols]
        if not self.variances:
            return df.withColumn("cluster", nearest(cols, self.centers))
        return df.withColumn("cluster", _best(_log_weights(cols, self)))


def first_rows(df: DataFrame, k: int, cols: Sequence[str] = AXES) -> list[list[float]]:
    """The k rows of least id: a reproducible start."""
    return [[float(r[c]) for c in cols] for r in df.orderBy("point_id").limit(k).collect()]


def random_rows(df: DataFrame, k: int, seed: int = 0, cols: Sequence[str] = AXES) -> list[list[float]]:
    """k distinct rows by a seeded hash."""
    rows = df.select(*cols, "point_id").orderBy(F.xxhash64(F.lit(seed), "point_id"), "point_id").limit(k).collect()
    return [[float(r[c]) for c in cols] for r in rows]


def nearest(cols: list[Column], centers: list[list[float]]) -> Column:
    """Number of the nearest centre, the lowest of equals."""
    structs = []
    for k, c in enumerate(centers):
        terms = [(x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(cols, c, strict=True)]
        structs.append(F.struct(F.sqrt(sum(terms[1:], terms[0])).alias("d"), F.lit(k).alias("k")))
    return F.array_min(F.array(*structs))["k"]


def kmeans(df: DataFrame, k: int, init: list[list[float]] | None = None, max_iter: int = 300, tol: float = 1e-4, cols: Sequence[str] = AXES) -> Model:
    """Lloyd's rounds until no centre moves by ``tol`` or more on any axis. An empty cluster keeps its centre.

    A round is one partial and final aggregation of k rows.
    """
    model = Model(list(cols), init or first_rows(df, k, cols))
    for _ in range(max_iter):
        found = {r["cluster"]: [r[c] for c in cols] for r in model.predict(df).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).collect()}
        new = [found.get(j, c) for j, c in enumerate(model.centers)]
        moved = max((abs(a - b) for p, q in zip(new, model.centers, strict=True) for a, b in zip(p, q, strict=True)), default=0.0)
        model.centers, model.iterations = new, model.iterations + 1
        if moved < tol:
            break
    return model


def kmeans_by(df: DataFrame, k: int, by: Sequence[str], max_iter: int = 300, tol: float = 1e-4, cols: Sequence[str] = AXES) -> DataFrame:
    """``df`` with ``cluster``: Lloyd's rounds of every cloud at once, each from its k rows of least id and until its own centres rest.

    The centres are a table of one row a cloud, joined to the points; a round is one aggregation for all clouds.
    """
    by, at = list(by), F.array(*cols)
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("point_id"))).where(F.col("_k") <= k)
    centers = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("point_id", at.cast("array<double>").alias("c")))).alias("s"))
    centers = cut(centers.select(*by, F.transform("s", lambda x: x["c"]).alias("centers"), F.lit(False).alias("still")))

    def gap(c: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(F.array(*[F.col(x).cast("double") for x in cols]), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))

    def labelled(points: DataFrame, fitted: DataFrame) -> DataFrame:
        gaps = F.transform("centers", lambda c, j: F.struct(gap(c).alias("d"), j.cast("int").alias("k")))
        return cloud.same_cloud(points, fitted.select(*by, "centers"), by).withColumn("cluster", F.array_min(gaps)["k"]).drop("centers")

    for _ in range(max_iter):
        means = labelled(df, centers.where("not still")).groupBy(*by, "cluster").agg(F.array(*[F.avg(c) for c in cols]).alias("c"))
        new = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "c"))).alias("m"))
        new = cloud.same_cloud(centers, new, by, "left")
        moved = F.when(F.col("m").isNull(), F.col("centers")).otherwise(F.transform("centers", lambda c, j: F.coalesce(F.col("m")[j.cast("int")], c)))
        new = new.withColumn("next", moved)
        far = F.array_max(F.flatten(F.zip_with("centers", "next", lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)))))
        centers = cut(new.select(*by, F.col("next").alias("centers"), (F.col("still") | (far < tol)).alias("still")))
        if centers.where("not still").isEmpty():
            break
    return labelled(df, centers)


def _log_weights(cols: list[Column], model: Model) -> list[Column]:
    return [F.lit(math.log(w) if w > 0 else -1e300) + g.log_gaussian(cols, m, v) for w, m, v in zip(model.weights, model.centers, model.variances, strict=True)]


def _best(logs: list[Column]) -> Column:
    return F.array_min(F.array(*[F.struct((-v).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(logs)]))["k"]


def responsibilities(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with w0..wk-1, each point's share in every component (in log space, so far points don't vanish)."""
    logs = _log_weights([F.col(c) for c in model.cols], model)
    out = df.withColumns({f"_l{k}": v for k, v in enumerate(logs)})
    top = F.greatest(*[F.col(f"_l{k}") for k in range(len(logs))]) if len(logs) > 1 else F.col("_l0")
    out = out.withColumn("_top", top).withColumns({f"_e{k}": F.exp(F.col(f"_l{k}") - F.col("_top")) for k in range(len(logs))})
    total = sum((F.col(f"_e{k}") for k in range(1, len(logs))), F.col("_e0"))
    return out.withColumns({f"w{k}": F.col(f"_e{k}") / total for k in range(len(logs))}).select(*df.columns, *[f"w{k}" for k in range(len(logs))])


def gmm_start(df: DataFrame, k: int, init: list[list[float]] | None = None, cols: Sequence[str] = AXES) -> Model:
    centers = init or first_rows(df, k, cols)
    return Model(list(cols), centers, weights=[1.0 / k] * k, variances=[[1.0] * len(cols) for _ in range(k)])


def gmm_step(df: DataFrame, model: Model) -> Model:
    """One round of expectation and maximisation for diagonal covariances, in one aggregation.

    Squares are summed about the old means, from which the variance about the new ones follows exactly. A component that
    collapses on an axis starts again from the first row with unit variances.
    """
    k, cols = len(model.centers), model.cols
    w = responsibilities(df, model)
    sums = []
    for j in range(k):
        sums.append(F.sum(f"w{j}").alias(f"n{j}"))
        for c, m in zip(cols, model.centers[j], strict=True):
            d = F.col(c) - F.lit(m)
            sums += [F.sum(F.col(f"w{j}") * d).alias(f"s{j}{c}"), F.sum(F.col(f"w{j}") * d * d).alias(f"q{j}{c}")]
    r = w.agg(*sums).first()
    total = sum(r[f"n{j}"] for j in range(k))
    centers, variances = [], []
    for j in range(k):
        shift = [r[f"s{j}{c}"] / r[f"n{j}"] if r[f"n{j}"] > 0 else 0.0 for c in cols]
        var = [r[f"q{j}{c}"] / r[f"n{j}"] - s * s if r[f"n{j}"] > 0 else 0.0 for c, s in zip(cols, shift, strict=True)]
        if min(var) <= 0:
            centers.append(first_rows(df, 1, cols)[0])
            variances.append([1.0] * len(cols))
        else:
            centers.append([m + s for m, s in zip(model.centers[j], shift, strict=True)])
            variances.append(var)
    return Model(cols, centers, model.iterations + 1, [r[f"n{j}"] / total for j in range(k)], variances)


def gmm_diag(df: DataFrame, k: int, init: list[list[float]] | None = None, max_iter: int = 50, cols: Sequence[str] = AXES) -> Model:
    model = gmm_start(df, k, init, cols)
    for _ in range(max_iter):
        model = gmm_step(df, model)
    return model


def dbscan(df: DataFrame, r: float = 1.0, min_sample: int = 20, by: Sequence[str] | None = None) -> DataFrame:
    """point_id, is_core, cluster: the least core id of the cluster, -1 for noise.

    A core point has at least ``min_sample`` points within r, itself included; clusters are components of core points within r; another
    point near core points joins the least of their clusters. Points of one cell with diagonal r are all neighbours: a cell of ``min_sample`` points
    needs no counting, and cells are what is linked, so no pair of points is ever written.
    """
    by = clouds(df, by)
    cell = ["_ci", "_cj", "_ck"]
    size = r / math.sqrt(3) * (1 - 1e-9) if r > 0 else 1.0
    points = df.select(*by, "point_id", *AXES).withColumns({c: F.floor(F.col(a) / size) for c, a in zip(cell, AXES, strict=True)})
    if r <= 0:  # only points in one place are neighbours
        points = points.withColumns(dict(zip(cell, map(F.col, AXES), strict=True)))
    points = cut(points.withColumn("_n", F.count("*").over(Window.partitionBy(*by, *cell))))
    counted = neighbors.radius_join(points.where(F.col("_n") < min_sample), points, r, by=by).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.count("*").alias("n"))
    sparse = points.join(counted.where(F.col("n") >= min_sample).select(*by, "point_id"), [*by, "point_id"], "left_semi")
    core = points.where(F.col("_n") >= min_sample).union(sparse)
    core = cut(core.withColumn("node", F.min("point_id").over(Window.partitionBy(*by, *cell))))
    links = neighbors.radius_join(core, core, r, by=by, carry=["node"]).where("q_node < n_node").select(*by, F.col("q_node").alias("src"), F.col("n_node").alias("dst")).distinct()
    label = graph.connected_components(core, links, "node", by)
    core = cut(core.join(label, [*by, "node"]).select(*by, "point_id", *AXES, "label"))
    rest = points.join(core.select(*by, "point_id"), [*by, "point_id"], "left_anti")
    near = neighbors.radius_join(rest.withColumn("label", F.lit(None).cast("long")), core, r, by=by, carry=["label"]).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.min("n_label").alias("near"))
    out = df.select(*by, "point_id").join(core.select(*by, "point_id", "label"), [*by, "point_id"], "left").join(near, [*by, "point_id"], "left")
    return out.select(*by, "point_id", F.col("label").isNotNull().alias("is_core"), F.coalesce("label", "near", F.lit(-1)).cast("long").alias("cluster"))


def _embedding(ids: np.ndarray, best: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    """Rows from eigenvectors of S, one a column: scaled to the random walk's, of length 1, the largest entry positive."""
    best = best * root[:, None]
    best /= np.sqrt((best**2).sum(axis=0))
    big = best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])]
    return pd.DataFrame({"point_id": ids, "v": list(best * np.where(big < 0, -1.0, 1.0))})


def _dense_eigenvectors(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.r_[pdf["src"], pdf["dst"]], return_inverse=True)
        src, dst = np.split(at, 2)
        w = np.zeros((len(ids), len(ids)))
        w[src, dst] = pdf["w"]
        root = 1.0 / np.sqrt(w.sum(axis=1))
        values, vectors = np.linalg.eigh(root[:, None] * w * root[None, :])
        return _embedding(ids, vectors[:, ::-1][:, :k], root)

    return run


def _sparse_product(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, wide: int = 32):
    """For edges sorted by src: the order in which it takes the nodes (those with most edges first), and a function from vectors (a row each) to their products.

    The j-th edges of all nodes that have so many are one step: nodes in that order make them a prefix. What a node has beyond ``wide`` edges is summed in one go.
    """
    count = np.bincount(src, minlength=n)
    order = np.argsort(-count, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first, falling = (np.cumsum(count) - count)[order], -count[order]
    steps = []
    for j in range(min(wide, count.max())):
        at = first[: np.searchsorted(falling, -j)] + j
        steps.append((place[dst[at]], w[at]))
    more = -wide - falling[: np.searchsorted(falling, -wide)]  # edges that are left
    ends = np.cumsum(more)
    rest = np.repeat(first[: len(more)] + wide - (ends - more), more) + np.arange(more.sum())
    to, by = place[dst[rest]], w[rest]

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for x, y in zip(v, out, strict=True):
            for at, weight in steps:
                y[: len(at)] += x.take(at, mode="clip") * weight
            if len(more):
                y[: len(more)] += np.add.reduceat(x[to] * by, ends - more)
        return out

    return order, times


def _leading(times, start: np.ndarray, k: int, tol: float, extra: int = 2, degree: int = 15, most: int = 36, kept: int = 12) -> np.ndarray:
    """The k eigenvectors (rows) of greatest eigenvalue of a symmetric product with spectrum in [-1, 1], residuals below ``tol``: Chebyshev-Davidson.

    The basis grows by the leading vectors that aren't there yet, filtered by a Chebyshev polynomial that damps what lies below the kept Ritz values;
    a full basis starts again from these. Blocks of k + ``extra`` random vectors find equal eigenvalues together.
    """
    n, b = start.shape[1], min(start.shape[1], k + extra)
    kept, most = max(kept, 2 * b), max(most, 6 * b)

    def added(basis: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for _ in range(2):
            rows = np.linalg.qr((rows - (rows @ basis.T) @ basis).T)[0].T
        return np.ascontiguousarray(rows)

    v = added(np.zeros((0, n)), np.r_[start, np.random.default_rng(0).normal(size=(b - len(start), n))])
    av = times(v)
    while True:
        h = v @ av.T
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn.T[::-1]
        x = turn[:b] @ v
        left = np.sqrt(((turn[:b] @ av - ritz[:b, None] * x) ** 2).sum(axis=1))
        if left[:k].max() < tol or len(v) == n:
            return x[:k]
        if len(v) + b > most:
            v, av = turn[:kept] @ v, turn[:kept] @ av
        cut_at = ritz[min(kept, len(ritz) - 1)]
        mid, half = (cut_at - 1) / 2, max((cut_at + 1) / 2, 1e-3)
        before = x[left >= tol][: n - len(v)]
        here = (times(before) - mid * before) / half
        for _ in range(degree - 1):
            before, here = here, (times(here) - mid * here) * (2 / half) - before
        t = added(v, here / np.sqrt((here**2).sum(axis=1, keepdims=True)))
        v, av = np.r_[v, t], np.r_[av, times(t)]


def _sparse_eigenvectors(k: int, tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])  # sums in one order, however rows arrive
        ids, src = np.unique(pdf["src"], return_inverse=True)
        dst, w = np.searchsorted(ids, pdf["dst"]), pdf["w"].to_numpy()
        degree = np.bincount(src, w)
        if not (np.isfinite(w).all() and (degree > 0).all()):
            raise ValueError("a node's edges must have finite weights that aren't all 0")
        root = 1.0 / np.sqrt(degree)
        order, times = _sparse_product(src, dst, w * root[src] * root[dst], len(ids))
        best = np.empty((len(ids), k))
        best[order] = _leading(times, np.sqrt(degree)[None, order], k, tol).T
        return _embedding(ids, best, root)

    return run


def _iterated_eigenvectors(edges: DataFrame, k: int, tol: float, extra: int = 8, degree: int = 10) -> DataFrame:
    """Subspace iteration on S = D^-1/2 W D^-1/2 with a Chebyshev filter, until the leading k residuals are below ``tol``.

    A product is a join and a sum; a round is ``degree`` of them, which damp what lies below the least Ritz value of k + ``extra`` vectors,
    then one aggregation whose small matrices are solved on the driver.
    """
    d = graph.degree(edges)
    e = edges.join(d.select(F.col("src"), F.sqrt("degree").alias("a")), "src").join(d.select(F.col("src").alias("dst"), F.sqrt("degree").alias("b")), "dst")
    e = cut(e.select("src", "dst", (F.col("w") / (F.col("a") * F.col("b"))).alias("w")))
    m = k + extra
    y, z = [f"y{j}" for j in range(m)], [f"z{j}" for j in range(m)]
    v = cut(d.select(F.col("src").alias("n"), *[(F.sqrt("degree") if not j else F.hash("src", F.lit(j)) / float(2**31)).alias(c) for j, c in enumerate(y)]))

    def times(t: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
        return e.join(t.select(F.col("n").alias("dst"), *cols), "dst").groupBy(F.col("src").alias("n")).agg(*[F.sum(F.col("w") * F.col(c)).alias(x) for c, x in zip(cols, names, strict=True)])

    def mixed(t: DataFrame, cols: list[str], by: np.ndarray, names: list[str]) -> list[Column]:
        return [sum((F.col(c) * F.lit(float(by[i, j])) for i, c in enumerate(cols) if i), F.col(cols[0]) * F.lit(float(by[0, j]))).alias(x) for j, x in enumerate(names)]

    while True:
        both = cut(v.join(times(v, y, z), "n"))
        sums = both.agg(F.array(*[F.sum(F.col(a) * F.col(b)) for p, q in ((y, y), (y, z), (z, z)) for a in p for b in q])).first()[0]
        vv, va, aa = np.array(sums).reshape(3, m, m)
        unit = np.diag(1.0 / np.sqrt(np.diag(vv)))
        back = unit @ np.linalg.inv(np.linalg.cholesky(unit @ vv @ unit + 1e-13 * np.eye(m))).T
        ritz, turn = np.linalg.eigh(back.T @ (va + va.T) / 2 @ back)
        turn, ritz = (back @ turn)[:, ::-1], ritz[::-1]
        left = [float(t @ aa @ t - 2 * x * (t @ va @ t) + x * x * (t @ vv @ t)) for t, x in zip(turn.T, ritz, strict=True)]
        if max(left[:k]) < tol * tol:
            out = both.select("n", *mixed(both, y, turn[:, :k], y[:k])).join(d.withColumnRenamed("src", "n"), "n")
            out = cut(out.select(F.col("n").alias("point_id"), *[(F.col(c) / F.sqrt("degree")).alias(c) for c in y[:k]]))
            # as in ``_embedding``: of length 1, the largest entry positive
            scale = out.agg(*[(F.sqrt(F.sum(F.col(c) * F.col(c))) * F.signum(F.max_by(c, F.struct(F.abs(c), -F.col("point_id"))))).alias(c) for c in y[:k]]).first()
            return out.select("point_id", F.array(*[F.col(c) / F.lit(scale[c]) for c in y[:k]]).alias("v"))
        mid, half = (ritz[-1] - 1) / 2, max((ritz[-1] + 1) / 2, 1e-3)  # damp [-1, least Ritz value]
        before = both.select("n", *mixed(both, y, turn, y))
        here = both.select("n", *[((a - mid * b) / half).alias(c) for c, a, b in zip(y, mixed(both, z, turn, z), mixed(both, y, turn, y), strict=True)])
        for _ in range(degree - 1):
            after = times(here, y, z).join(here, "n").join(before.select("n", *[F.col(c).alias(f"b{c}") for c in y]), "n")
            before, here = here, after.select("n", *[((F.col(a) - mid * F.col(c)) * 2 / half - F.col(f"b{c}")).alias(c) for c, a in zip(y, z, strict=True)])
            if _ % 3 == 2:
                both = cut(here.join(before.select("n", *[F.col(c).alias(f"b{c}") for c in y]), "n"))
                here, before = both.select("n", *y), both.select("n", *[F.col(f"b{c}").alias(c) for c in y])
        top = here.agg(*[F.max(F.abs(c)) for c in y]).first()
        v = cut(here.select("n", *[(F.col(c) / F.lit(x or 1.0)).alias(c) for c, x in zip(y, top, strict=True)]))


def spectral_embedding(edges: DataFrame, k: int, dense_limit: int = 4000, tol: float = 1e-6, sparse_limit: int = 400_000) -> DataFrame:
    """point_id, v: the k eigenvectors of least eigenvalue of the random-walk Laplacian of one cloud's graph.

    Up to ``dense_limit`` nodes one task takes the dense matrix; up to ``sparse_limit`` one task takes the edges (about a kilobyte a node) and goes on until
    residuals are below a thousandth of ``tol``; beyond, eigenvectors come from distributed subspace iteration, until residuals are below ``tol``.
    All give the same vectors up to that and to a turn within equal eigenvalues.
    """
    n = edges.select("src").distinct().count()
    if n <= max(dense_limit, k + 8):
        run = _dense_eigenvectors(k)
    elif n <= sparse_limit:
        run = _sparse_eigenvectors(k, tol / 1000)
    else:
        return _iterated_eigenvectors(edges, k, tol)
    return edges.select("src", "dst", "w", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "point_id long, v array<double>")


def _kmeans_at_once(k: int, max_iter: int, tol: float):
    """``kmeans`` from the rows of ``_far_apart``, in one task on rows point_id, v."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        v = np.stack(pdf["v"])

        def gaps(centers: np.ndarray) -> np.ndarray:
            return np.stack([((v - c) ** 2).sum(axis=1) for c in centers])

        centers = v[:1]
        while len(centers) < k:
            centers = np.r_[centers, v[gaps(centers).min(axis=0).argmax()][None]]
        for _ in range(max_iter):
            label = np.sqrt(gaps(centers)).argmin(axis=0)
            new = np.stack([v[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centers)])
            moved, centers = np.abs(new - centers).max(), new
            if moved < tol:
                break
        return pd.DataFrame({"point_id": pdf["point_id"], "cluster": np.sqrt(gaps(centers)).argmin(axis=0).astype(np.int32)})

    return run


def spectral(df: DataFrame, k: int, n_neighbors: int = 10, sigma: float = 1.0, max_iter: int = 100, dense_limit: int = 4000, sparse_limit: int = 400_000) -> DataFrame:
    """point_id, cluster: K-Means on the spectral embedding of the neighbour graph of one cloud (fewer neighbours if there are fewer points).

    Up to ``sparse_limit`` points one task takes the K-Means too, as its rounds are many and short.
    """
    n = df.count()
    if n < 2:
        return df.select("point_id", F.lit(0).alias("cluster"))
    edges = cut(neighbors.knn_graph(df, min(n_neighbors, n - 1), sigma, by=()))
    found = spectral_embedding(edges, k, dense_limit, sparse_limit=sparse_limit)
    if n <= sparse_limit:
        return cut(found).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_kmeans_at_once(k, max_iter, 1e-8), "point_id long, cluster int")
    v = cut(found.select("point_id", *[F.col("v")[j].alias(f"v{j}") for j in range(k)]))
    cols = [f"v{j}" for j in range(k)]
    return kmeans(v, k, _far_apart(v, k, cols), max_iter, 1e-8, cols).predict(v).select("point_id", "cluster")


def power_iteration(df: DataFrame, k: int, n_neighbors: int = 10, sigma: float = 1.0, max_iter: int = 20) -> DataFrame:
    """point_id, cluster: Spark's power-iteration clustering of the neighbour graph of one cloud."""
    from pyspark.ml.clustering import PowerIterationClustering

    n = df.count()
    if n < 2:
        return df.select("point_id", F.lit(0).alias("cluster"))
    edges = neighbors.knn_graph(df, min(n_neighbors, n - 1), sigma, by=()).where("src < dst")
    found = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="w", initMode="degree").assignClusters(cut(edges))
    return found.select(F.col("id").alias("point_id"), "cluster")


def _far_apart(df: DataFrame, k: int, cols: list[str]) -> list[list[float]]:
    """The row of least id, then k - 1 times the row farthest from those chosen."""
    chosen = first_rows(df, 1, cols)
    while len(chosen) < k:
        gaps = []
        for c in chosen:
            terms = [(F.col(n) - F.lit(v)) * (F.col(n) - F.lit(v)) for n, v in zip(cols, c, strict=True)]
            gaps.append(sum(terms[1:], terms[0]))
        row = df.orderBy(F.desc(F.least(*gaps) if len(gaps) > 1 else gaps[0]), "point_id").first()
        chosen.append([float(row[c]) for c in cols])
    return chosen


def cluster(df: DataFrame, method: str = "dbscan", by: Sequence[str] | None = None, **options) -> DataFrame:
    """point_id, cluster by name of method: dbscan, kmeans, gmm, spectral; bisecting, gmm_full (full covariance) and power are Spark's own.

    Clouds are clustered each by itself: dbscan and kmeans all at once, the others one cloud after the other.
    """
    by = clouds(df, by)
    if method not in ("dbscan", "kmeans", "gmm", "spectral", "power", "bisecting", "gmm_full"):
        raise ValueError(f"unknown method {method!r}")
    if method == "dbscan":
        return dbscan(df, by=by, **options).select(*by, "point_id", "cluster")
    if method == "kmeans" and by:
        return kmeans_by(df, by=by, **options).select(*by, "point_id", "cluster")
    if by:
        names = df.select(*by).distinct().orderBy(*by).collect()  # one row a cloud
        each = []
        for row in names:
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in by])
            each.append(cluster(df.where(same).drop(*by), method, (), **options).select(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in by], "point_id", "cluster"))
        return reduce(DataFrame.union, each) if each else df.select(*by, "point_id", F.lit(0).alias("cluster"))
    if method == "kmeans":
        return kmeans(df, **options).predict(df).select("point_id", "cluster")
    if method == "gmm":
        return gmm_diag(df, **options).predict(df).select("point_id", "cluster")
    if method in ("spectral", "power"):
        return (spectral if method == "spectral" else power_iteration)(df, **options)
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(AXES), outputCol="_f").transform(df)
    kind = BisectingKMeans if method == "bisecting" else GaussianMixture
    return kind(featuresCol="_f", predictionCol="cluster", seed=1, **options).fit(rows).transform(rows).select("point_id", "cluster")
