"""Hand fixtures, properties and brute-force comparisons of the point operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.operators import cloud, clustering, features, graph, neighbors, planes, stats, trees, voxel
from cairn.operators.session import cut
from cairn.sources import tables

SIX = [(1.0, 2.0), (1.5, 1.8), (5.0, 8.0), (8.0, 8.0), (1.0, 0.6), (9.0, 11.0)]


def points(spark, rows, extra=""):
    rows = [(k, *map(float, r), *[0.0] * (3 - len(r))) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def random_points(spark, n, seed=0, scale=1.0):
    return np.random.default_rng(seed).random((n, 3)) * scale


def test_nearest_on_a_line(spark):
    db = points(spark, [(0,), (1,), (9,), (10,)])
    q = points(spark, [(9.2,)])
    assert [r["neighbor_id"] for r in neighbors.knn_join(q, db, 1).collect()] == [2]


def test_fewer_points_than_asked_for(spark):
    db = points(spark, [(0,), (1,), (5,)])
    rows = neighbors.knn_join(db.limit(1), db, 5).orderBy("rank").collect()
    assert [(r["neighbor_id"], r["rank"]) for r in rows] == [(0, 1), (1, 2), (2, 3)]


def test_radius_includes_its_edge(spark):
    db = points(spark, [(0,), (1,), (2.5,)])
    assert sorted((r["query_id"], r["neighbor_id"]) for r in neighbors.radius_join(db, db, 1.0, exclude_self=True).collect()) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("k,exclude", [(1, False), (5, True)])
def test_knn_is_brute_force(spark, k, exclude):
    rows = np.vstack([random_points(spark, 80, 1), random_points(spark, 40, 2, 0.01), [[50.0, 50.0, 50.0]], np.zeros((3, 3))])
    db = points(spark, rows.tolist())
    got = neighbors.knn_join(db, db, k, exclude_self=exclude).select("query_id", "rank", "neighbor_id").collect()
    want = neighbors.knn_brute(db, db, k, exclude_self=exclude).select("query_id", "rank", "neighbor_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_radius_keeps_clouds_apart(spark):
    a = points(spark, [(0,), (0.5,)]).withColumn("cloud_id", F.lit("a"))
    b = points(spark, [(0,), (0.5,), (0.6,)]).withColumn("cloud_id", F.lit("b"))
    both = a.union(b)
    assert neighbors.radius_join(both, both, 1.0, by=["cloud_id"]).groupBy("cloud_id").count().orderBy("cloud_id").collect() == [("a", 4), ("b", 9)]


def test_voxel_keys_collide_only_when_linear(spark):
    db = points(spark, [(0, 0, 0), (2.4, 0.2, 0), (0.2, 1.2, 0), (2.5, 2.5, 0)])
    assert voxel.voxel_filter(db, 1.0).count() == 4
    assert voxel.voxel_filter(db, 1.0, "linear_float").count() == 3
    assert voxel.voxel_filter(db, 1.0).agg(F.sum("n_points")).first()[0] == 4


def test_hashed_runs(spark):
    db = points(spark, [(0, 0, 0), (5, 0, 0), (0.1, 0, 0), (0.2, 0, 0)])
    runs = voxel.voxel_filter_hashed(db, 1.0, 1).orderBy("run").collect()
    assert [(r["run"], r["n_points"]) for r in runs] == [(0, 1), (1, 1), (2, 2)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (1.0000001,)], "v double")
    rows = stats.histogram(df, F.col("v"), -1.0, 1.0, 6).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 1), (3, 1), (5, 1)]


def test_eigenvalues_and_vectors(spark):
    rng = np.random.default_rng(3)
    m = np.einsum("nij,nkj->nik", *[rng.normal(size=(50, 3, 3))] * 2)
    m = np.concatenate([m, [np.eye(3), np.zeros((3, 3))]])
    df = spark.createDataFrame([(k, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for k, a in enumerate(m)], "k int, " + ", ".join(f"{a}{b} double" for a, b in stats.UPPER))
    want = np.linalg.eigvalsh(m)[:, ::-1]
    got = np.array([list(r)[1:] for r in stats.scatter_eigenvalues(df, ["k"]).orderBy("k").collect()])
    assert np.allclose(got, want, atol=1e-9)
    for r in df.select("k", stats.eigenpairs(*[f"{a}{b}" for a, b in stats.UPPER]).alias("p")).collect():
        for value, *v in r["p"]:
            assert np.allclose(m[r["k"]] @ v, value * np.array(v), atol=1e-8)
            assert v[int(np.abs(np.round(v, 12)).argmax())] > 0


def test_pca_of_a_flat_cloud(spark):
    rows = [(x, y, 2.0) for x in range(5) for y in range(3)]
    last = stats.pca(points(spark, rows)).where("component = 3").first()
    assert (abs(last["eigenvalue"]), last["vz"]) == (pytest.approx(0), pytest.approx(1))


def test_least_squares_plane(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((60, 2))
    p = planes.lsq_plane(points(spark, [(x, y, 0.5 * x - 0.2 * y + 1) for x, y in xy])).first()
    n = np.array([p["a"], p["b"], p["c"]])
    assert np.allclose(n / n[2], [-0.5, 0.2, 1.0]) and p["d"] / p["c"] == pytest.approx(-1.0)


def test_ransac_finds_the_ground(spark):
    rng = np.random.default_rng(1)
    ground = [(*p, 0.0) for p in rng.random((200, 2)) * 10]
    above = rng.random((40, 3)) * 10 + [0, 0, 1]
    out = planes.ground_split(points(spark, [*ground, *above.tolist()]), tao=0.05)
    assert out.where("is_ground").count() >= 200 and out.where("point_id < 200 and not is_ground").count() == 0


def test_no_plane_through_a_line(spark):
    out = planes.ground_split(points(spark, [(k, k, k) for k in range(20)]))
    assert out.where("is_ground").count() == 0 and out.count() == 20


def test_kmeans_by_hand(spark):
    df = points(spark, SIX)
    one = clustering.kmeans(df, 2, max_iter=1, cols=("x", "y"))
    assert np.allclose(one.centers, [[1.0, 2.0], [4.9, 5.88]])
    model = clustering.kmeans(df, 2, cols=("x", "y"))
    assert [r["cluster"] for r in model.predict(df).orderBy("point_id").collect()] == [0, 0, 1, 1, 0, 1]
    assert np.allclose(model.centers, [[3.5 / 3, 4.4 / 3], [22 / 3, 9.0]])


def test_empty_cluster_keeps_its_centre(spark):
    model = clustering.kmeans(points(spark, SIX), 3, init=[[1.0, 1.0], [8.0, 9.0], [900.0, 900.0]], cols=("x", "y"))
    assert model.centers[2] == [900.0, 900.0]


def test_mixture_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 2)) * [1, 2] + np.repeat([[0, 0], [6, 3]], 100, axis=0)
    model = clustering.gmm_diag(points(spark, x.tolist()), 2, init=[[0.0, 0.0], [5.0, 3.0]], max_iter=5, cols=("x", "y"))
    pi, mu, var = np.full(2, 0.5), np.array([[0.0, 0.0], [5.0, 3.0]]), np.ones((2, 2))
    for _ in range(5):
        pdf = np.stack([p * np.exp(-0.5 * ((x - m) ** 2 / v).sum(1)) / np.sqrt((2 * math.pi) ** 2 * v.prod()) for p, m, v in zip(pi, mu, var, strict=True)], 1)
        w = pdf / pdf.sum(1, keepdims=True)
        pi, mu = w.sum(0) / w.sum(), (w.T @ x) / w.sum(0)[:, None]
        var = np.stack([(w[:, k] @ (x - mu[k]) ** 2) / w[:, k].sum() for k in range(2)])
    assert np.allclose(model.centers, mu) and np.allclose(model.variances, var) and np.allclose(model.weights, pi)


def test_dbscan_by_hand(spark):
    rows = [(0,), (1,), (2,), (3.4,), (10,), (11,), (12,), (30,)]
    out = {r["point_id"]: (r["is_core"], r["cluster"]) for r in clustering.dbscan(points(spark, rows), 1.5, 3).collect()}
    assert [out[k][1] for k in range(8)] == [0, 0, 0, 0, 5, 5, 5, -1] or [out[k][1] for k in range(8)] == [1, 1, 1, 1, 5, 5, 5, -1]
    assert out[7] == (False, -1)


def test_spectral_on_six_points(spark):
    out = [r["cluster"] for r in clustering.spectral(points(spark, SIX), 2).orderBy("point_id").collect()]
    assert len(out) == 6 and out[0] == out[1] == out[4]


def test_spectral_ways_agree(spark):
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.normal(size=(15, 3)) * 0.3, rng.normal(size=(15, 3)) * 0.3 + 0.7]).tolist()
    edges = neighbors.knn_graph(points(spark, rows), 12).cache()  # one component, so the leading vectors are unique
    sides = []
    for limit in (4000, 0):
        v = clustering.spectral_embedding(edges, 2, dense_limit=limit).orderBy("point_id").collect()
        ratio = np.array([r["v"][1] / r["v"][0] for r in v])
        sides.append(ratio > np.median(ratio))
    assert (sides[0] == sides[1]).all() or (sides[0] != sides[1]).all()


def test_spectral_ways_agree_on_close_eigenvalues(spark):
    """Overlapping blobs, whose leading eigenvalues lie close together: the same subspace either way."""
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(60, 2)) + c for c in ((0, 0), (3, 0), (0, 3))]).tolist()
    edges = neighbors.knn_graph(points(spark, rows), 10).cache()
    both = [np.array([r["v"] for r in clustering.spectral_embedding(edges, 3, dense_limit=limit).orderBy("point_id").collect()]) for limit in (4000, 0)]
    q = [np.linalg.qr(v)[0] for v in both]
    assert np.linalg.svd(q[0].T @ q[1])[1].min() > 1 - 1e-6


@pytest.mark.parametrize("sparse_limit", [400_000, 0])
def test_spectral_ways_give_the_same_vectors(spark, sparse_limit):
    """The edges in one task, and spread out, give the dense matrix's vectors: their length and sign too."""
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(60, 2)) + c for c in ((0, 0), (3, 0), (0, 3))]).tolist()
    edges = neighbors.knn_graph(points(spark, rows), 10).cache()
    both = [clustering.spectral_embedding(edges, 3, dense_limit=d, sparse_limit=sparse_limit).orderBy("point_id").collect() for d in (4000, 0)]
    assert [r["point_id"] for r in both[0]] == [r["point_id"] for r in both[1]]
    assert np.abs(np.array([r["v"] for r in both[0]]) - np.array([r["v"] for r in both[1]])).max() < (1e-7 if sparse_limit else 1e-4)


def test_spectral_beyond_the_dense_limit_makes_no_job_a_product(spark, monkeypatch):
    """4,200 points on a bent line, in one task: the second vector is in the order of the line."""
    monkeypatch.setattr(clustering, "_iterated_eigenvectors", None)
    t = np.arange(4200) / 4200
    edges = neighbors.knn_graph(points(spark, np.c_[40 * t, 5 * t * t, t].tolist()), 10)
    v = np.array([r["v"][1] for r in clustering.spectral_embedding(edges, 2).orderBy("point_id").collect()])
    assert len(v) == 4200 and (np.diff(v) * np.sign(v[-1] - v[0]) > 0).mean() > 0.99


@pytest.mark.parametrize("kind", ["blobs", "apart", "hub"])
def test_sparse_eigenvectors_against_dense(kind):
    """Also with equal eigenvalues (parts without an edge between them) and with a node of many edges."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3)) + (np.arange(240) // 80 * 9.0)[:, None] * (kind == "apart")
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 1:9]
    w = np.zeros((240, 240))
    w[np.arange(240)[:, None], near] = rng.random((240, 8)) + 0.5
    if kind == "hub":
        w[7, 20:200] = 0.1
    w = np.maximum(w, w.T)
    src, dst = np.nonzero(w)
    pdf = pd.DataFrame({"src": src * 3, "dst": dst * 3, "w": w[src, dst]}).sample(frac=1, random_state=1)
    out = [f(pdf).sort_values("point_id") for f in (clustering._dense_eigenvectors(4), clustering._sparse_eigenvectors(4, 1e-9))]
    assert (out[0]["point_id"] == out[1]["point_id"]).all()
    a, b = (np.stack(o["v"]) for o in out)
    assert np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0])[1].min() > 1 - 1e-9
    if kind != "apart":
        assert np.abs(a - b).max() < 1e-6


def test_kmeans_at_once_is_kmeans(spark):
    rng = np.random.default_rng(9)
    rows = [(3 * k, *p) for k, p in enumerate((rng.normal(size=(300, 3)) * [1.0, 0.5, 0.2]).round(1).tolist())]
    v, cols = spark.createDataFrame(rows, "point_id long, v0 double, v1 double, v2 double"), ["v0", "v1", "v2"]
    want = clustering.kmeans(v, 3, clustering._far_apart(v, 3, cols), 100, 1e-8, cols).predict(v).orderBy("point_id").collect()
    pdf = pd.DataFrame({"point_id": [r[0] for r in rows], "v": [np.array(r[1:]) for r in rows]}).sample(frac=1, random_state=2)
    got = clustering._kmeans_at_once(3, 100, 1e-8)(pdf)
    assert list(zip(got["point_id"], got["cluster"])) == [(r["point_id"], r["cluster"]) for r in want]


def test_neighbour_edges_are_computed_once(spark):
    """Both directions come from one search: before, each had a ranking of its own."""
    edges = spark.range(20).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst"), F.lit(1.0).alias("d2")).where("src <> dst")
    both = graph.symmetric(edges)
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, a % 7) for a in range(20) if a != a % 7}
    assert sorted((r["src"], r["dst"]) for r in both.collect()) == sorted(want | {(b, a) for a, b in want})


@pytest.mark.parametrize("r", [0.0, 0.05, 0.2])
def test_dbscan_against_a_plain_search(spark, r):
    rng = np.random.default_rng(6)
    m = np.vstack([rng.random((60, 3)) * 0.6, rng.normal(size=(60, 3)) * 0.02 + 0.3, np.full((7, 3), 0.9)])
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= r
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(m)), -1)
    for _ in range(len(m)):
        label = np.array([min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) if core[i] else -1 for i in range(len(m))])
    want = [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(m))]
    got = clustering.dbscan(points(spark, m.tolist()), r, 5).orderBy("point_id").collect()
    assert [x["cluster"] for x in got] == want and [x["is_core"] for x in got] == core.tolist()


def test_clouds_are_kept_apart(spark):
    """Two clouds whose ids collide give, together, the rows of each by itself."""
    rng = np.random.default_rng(7)
    xyz = "point_id long, x double, y double, z double, nx double, ny double, nz double"
    each = {}
    for name, n, scale in (("a", 60, 1.0), ("b", 45, 0.3)):
        v = rng.normal(size=(n, 3))
        each[name] = spark.createDataFrame([(k, *p, *u) for k, (p, u) in enumerate(zip((rng.random((n, 3)) * [scale, 1, 0.2]).tolist(), (v / np.linalg.norm(v, axis=1)[:, None]).tolist()))], xyz).cache()
    both = each["a"].withColumn("cloud_id", F.lit("a")).union(each["b"].withColumn("cloud_id", F.lit("b"))).cache()
    ways = {
        "normals": lambda p: features.normals(p, 8), "ground": lambda p: planes.ground_split(p, "ransac_lsq", 0.02), "iss": lambda p: features.iss_keypoints(p, 0.3, 0.2),
        "fpfh": lambda p: features.descriptor_rows(features.fpfh(p, 0.2)), "dbscan": lambda p: clustering.dbscan(p, 0.15, 4), "kmeans": lambda p: clustering.cluster(p, "kmeans", k=3, max_iter=4),
        "octree": lambda p: trees.octree_leaves(p, 8, 0.05), "kdtree": lambda p: trees.kdtree_leaves(p, 8), "voxel": lambda p: voxel.voxel_filter(p, 0.2), "runs": lambda p: voxel.voxel_filter_hashed(p, 0.2, 5), "slab": lambda p: cloud.low_slab(p, 0.3),
    }
    for way, f in ways.items():
        together = f(both)
        got = canonical_rows(together)
        want = sorted(x for name, p in each.items() for x in canonical_rows(f(p).withColumn("cloud_id", F.lit(name)).select(*together.columns)))
        assert got == want, way


def canonical_rows(df):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(x + 0.0 if isinstance(x, float) else x) for x in r) for r in df.collect())


def test_components(spark):
    nodes = spark.range(10).withColumnRenamed("id", "point_id")
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2)], "src long, dst long")
    out = {r["point_id"]: r["label"] for r in graph.connected_components(nodes, edges).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_overlap_radius():
    assert g.iou_radius(0.2, 0.4) == pytest.approx(0.11768, abs=1e-5)
    assert g.iou_radius(0.25, 0.6) == pytest.approx(0.08413, abs=1e-5)


def test_keypoints_against_a_plain_walk(spark, sf):
    p = tables.pts(spark, sf).cache()
    good = {r["point_id"]: r["l3"] for r in features.salient(p, 0.2).collect()}
    xyz = {r["point_id"]: np.array([r["x"], r["y"], r["z"]]) for r in p.collect()}
    reach = g.iou_radius(0.2, 0.4)
    for skip in (False, True):
        left, kept = sorted(good, key=lambda i: (good[i], i)), []
        while left:
            best = left.pop()
            kept.append(best)
            at = 0
            while at < len(left):
                if np.linalg.norm(xyz[left[at]] - xyz[best]) < reach:
                    del left[at]
                    at += skip
                else:
                    at += 1
        got = [r["point_id"] for r in features.iss_keypoints(p, 0.2, 0.4, compat_skip=skip).orderBy("order").collect()]
        assert got == kept


def test_normals_against_numpy(spark, sf):
    p = tables.pts(spark, sf).cache()
    m = np.array([[r["x"], r["y"], r["z"]] for r in p.orderBy("point_id").collect()])
    got = {r["point_id"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in features.normals(p, 20).collect()}
    for i in range(0, len(m), 37):
        near = m[np.argsort(((m - m[i]) ** 2).sum(1), kind="stable")[:20]]
        v = np.linalg.eigh(np.cov(near.T))[1][:, 0]
        assert abs(got[i] @ v) == pytest.approx(1, abs=1e-6)


def test_descriptor_properties(spark, sf):
    p = tables.pts(spark, sf)
    for r in features.spfh(p, 0.1, 6).limit(20).collect():
        assert sum(r["feature"]) == pytest.approx(3)
    for r in features.fpfh(p, 0.1, 6).limit(20).collect():
        assert sum(v * v for v in r["feature"]) == pytest.approx(1)
    flat = features.spfh(p, 0.1, 6, alpha="degenerate").first()["feature"]
    assert flat[:6] == [0, 0, 0, 1, 0, 0]


def test_octree_stops_at_its_least_extent(spark):
    leaves = trees.octree_leaves(points(spark, [(0, 0, 0)] * 5 + [(1, 1, 1)]), 2, 0.1)
    assert leaves.agg(F.sum("n_points")).first()[0] == 6 and leaves.agg(F.max("n_points")).first()[0] == 5


@pytest.mark.parametrize("split", ["median", "mean"])
def test_kdtree_leaves(spark, split):
    leaves = trees.kdtree_leaves(points(spark, random_points(spark, 64).tolist()), 4, split)
    assert leaves.agg(F.sum("n_points")).first()[0] == 64 and leaves.agg(F.max("n_points")).first()[0] <= 4
    same = trees.kdtree_leaves(points(spark, [(1, 1, 1)] * 10), 4, split)
    assert [r["n_points"] for r in same.collect()] == [10]
    rows = points(spark, [*random_points(spark, 40).round(1).tolist(), *[(0.5, 0.5, 0.5)] * 22])  # nodes split level by level give the same tree
    assert canonical_rows(trees.kdtree_leaves(rows, 4, split, task=20)) == canonical_rows(trees.kdtree_leaves(rows, 4, split))


def test_reindex_is_dense(spark):
    df = spark.range(1000, numPartitions=5).select((F.col("id") * 7 % 1000).alias("v"))
    assert [tuple(r) for r in cloud.reindex(df, ["v"]).orderBy("v").collect()] == [(k, k) for k in range(1000)]


def test_reindex_is_dense_at_size(spark, tmp_path):
    """A million rows with other columns, written out."""
    df = spark.range(1_000_000, numPartitions=7).select((F.col("id") * 7919 % 1_000_003).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    cloud.reindex(df, ["v"]).write.parquet(str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t"))
    assert tuple(out.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first()) == (1_000_000, 0, 999_999)


def test_kdtree_splits_a_line_to_the_end(spark):
    leaves = trees.kdtree_leaves(points(spark, [(k, 0, 0) for k in range(64)]), 1).collect()
    assert len(leaves) == 64 and {r["n_points"] for r in leaves} == {1} and {r["depth"] for r in leaves} == {6}


def test_pca_rebuild_with_all_components(spark):
    p = cloud.centre(points(spark, random_points(spark, 30).tolist()))
    for r in stats.pca_project(p, stats.pca(p), 3).collect():
        assert [r["rx"], r["ry"], r["rz"]] == pytest.approx([r["x"], r["y"], r["z"]])


def test_dispatcher_and_comparison(spark):
    from cairn.plans.compare import compare

    df = points(spark, [(k % 5 / 10, k // 5 / 10, k % 3 / 10) for k in range(25)] + [(9 + k % 5 / 10, k // 5 / 10, 1 + k % 3 / 10) for k in range(25)])
    for method, options in (("dbscan", {"r": 0.5, "min_sample": 3}), ("kmeans", {"k": 2, "init": [[0, 0, 0], [9, 0, 1]]}), ("bisecting", {"k": 2}), ("gmm", {"k": 2, "init": [[0, 0, 0], [9, 0, 1]], "max_iter": 3})):
        labels = [r["cluster"] for r in clustering.cluster(df, method, **options).orderBy("point_id").collect()]
        assert len(set(labels[:25])) == 1 == len(set(labels[25:])) and labels[0] != labels[25], method
    with pytest.raises(ValueError, match="unknown"):
        clustering.cluster(df, "none")
    rows, seconds = compare(spark, ("kmeans",), 60, ("blobs",))
    assert rows.count() == 60 and [x[:2] for x in seconds] == [("blobs", "kmeans")]


def test_registered_comparison_takes_whole_shapes(spark, monkeypatch):
    from cairn.plans import catalogue, compare

    whole = compare.compare
    monkeypatch.setattr(catalogue.compare, "compare", lambda s, methods, *size: whole(s, ("kmeans",), *size, shapes=("blobs",)))
    assert sum(r["n"] for r in catalogue.QUERIES["clustering_compare"](spark, "").collect()) == 1500


def written(spark):
    """Bytes that tasks have written for other tasks so far, and that lie in the checkpoint folder."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    kept = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() if folder else 0
    return kept + sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


@pytest.mark.parametrize("name", ["scatter", "eigenvalues", "salient", "fpfh", "keypoints", "describe"])
def test_no_pair_is_written(spark, name):
    """1,200 points that are all neighbours: 1,440,000 pairs of 24 bytes at least, none of which leaves the task that finds it."""
    run = {
        "scatter": lambda p: features.weighted_scatter(p, 2.0), "salient": lambda p: features.salient(p, 2.0),
        "eigenvalues": lambda p: stats.scatter_eigenvalues(features.weighted_scatter(p, 2.0), ["point_id"]),
        "fpfh": lambda p: features.fpfh(p, 2.0), "keypoints": lambda p: features.iss_keypoints(p, 2.0, 0.99),
        "describe": lambda p: features.describe(p, p.where("point_id < 50"), 2.0, height=2.0),
    }[name]
    rng = np.random.default_rng(9)
    p = points(spark, rng.random((1200, 3)).tolist())
    p = p.withColumns({f"n{c}": F.lit(1 / math.sqrt(3)) for c in "xyz"})
    before = written(spark)
    run(p).write.format("noop").mode("overwrite").save()
    assert written(spark) - before < 10_000_000


@pytest.mark.parametrize("name", ["keypoints", "describe"])
def test_no_conflict_is_written(spark, name):
    """1,200 salient points that all overlap: of 1,438,800 conflicts none leaves the task that finds it, and the best point is chosen."""
    rng = np.random.default_rng(10)
    p = points(spark, (rng.random((1200, 3)) * [1.0, 0.6, 0.3]).tolist())
    p = p.withColumns({f"n{c}": F.lit(1 / math.sqrt(3)) for c in "xyz"})
    best = features.salient(p, 4.0).orderBy(F.desc("l3"), F.desc("point_id")).first()["point_id"]
    before = written(spark)
    kept = features.iss_keypoints(p, 4.0, 0.1)
    if name == "describe":
        assert features.describe(p, kept, 4.0, height=2.0).count() == 18
    else:
        assert [r["point_id"] for r in kept.collect()] == [best]
    assert features.salient(p, 4.0).count() > 1100
    assert written(spark) - before < 5_000_000


def test_scatter_against_numpy(spark):
    """Repeated places, edges and clouds: the weight of a neighbour is one over its own count."""
    rng = np.random.default_rng(12)
    m = np.vstack([rng.random((60, 3)), np.zeros((5, 3)), [[9.0, 9.0, 9.0]]])
    p = points(spark, m.tolist()).withColumn("w", F.lit(7.0))
    both = p.withColumn("cloud_id", F.lit("a")).union(p.withColumn("cloud_id", F.lit("b")))
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)) <= 0.4
    w = near / near.sum(axis=1)[None, :]
    got = features.weighted_scatter(both, 0.4).collect()
    assert len(got) == 2 * len(m)
    for r in got:
        d = m - m[r["point_id"]]
        want = (w[r["point_id"]][:, None, None] * d[:, :, None] * d[:, None, :]).sum(0) / w[r["point_id"]].sum()
        assert np.allclose([r[a + b] for a, b in stats.UPPER], want[np.triu_indices(3)], atol=1e-12)


def test_fpfh_of_some_is_that_of_all(spark, sf):
    p = tables.pts(spark, sf).limit(150).cache()
    whole = {r["point_id"]: r["feature"] for r in features.fpfh(p, 0.1, 6).collect()}
    some = features.fpfh(p, 0.1, 6, p.where("point_id % 7 = 0").select("point_id")).collect()
    assert {r["point_id"] for r in some} == {i for i in whole if i % 7 == 0}
    assert all(np.allclose(r["feature"], whole[r["point_id"]], atol=1e-9) for r in some)


def sorted_bytes(plan):
    """The most memory of the sorts of an executed plan."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return sorted_bytes(plan.executedPlan())
    below = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(k) for k in range(plan.children().size())]
    mine = plan.metrics().apply("peakMemory").value() if plan.nodeName() == "Sort" else 0
    return max([mine, *map(sorted_bytes, below)])


def test_brute_force_sorts_no_pairs(spark):
    """2,000 points: 4,000,000 pairs of 32 bytes, of which only those that a block's nearest are go on to the ranks."""
    p = points(spark, random_points(spark, 2000).tolist())
    df = neighbors.knn_brute(p, p, 8)
    assert len(df.collect()) == 16_000
    assert sorted_bytes(df._jdf.queryExecution().executedPlan()) < 64_000_000


@pytest.mark.parametrize("k,exclude", [(1, True), (6, False), (50, True)])
def test_brute_force_in_blocks(spark, k, exclude):
    """Ties, points in one place, more neighbours asked for than there are, clouds and points without a place."""
    rng = np.random.default_rng(3)
    m = np.vstack([rng.integers(0, 3, (30, 3)), np.zeros((8, 3))])
    p = points(spark, m.tolist())
    lost = spark.createDataFrame([(90, None, 0.0, 0.0), (91, float("nan"), 0.0, 0.0)], p.schema)
    both = p.withColumn("cloud_id", F.lit("a")).union(p.where("point_id < 9").union(lost).withColumn("cloud_id", F.lit("b")))
    got = neighbors.knn_brute(both, both, k, exclude_self=exclude, blocks=(5, 7)).collect()
    want = []
    for c, x in (("a", m), ("b", m[:9])):
        for i in range(len(x)):
            d = sorted((float(np.sqrt(((y - x[i]) ** 2).sum())), j) for j, y in enumerate(x) if not exclude or i != j)
            want += [(c, i, j, dist, rank) for rank, (dist, j) in enumerate(d[:k], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sizes_don_t_multiply_in_loops(spark):
    """A checkpoint's statistics are the size of its files, whatever joins it came from; its rows and types stay."""
    df = cut(spark.range(100).select("id", (F.col("id") * 0.5).alias("v")))
    for _ in range(12):
        df = cut(df.join(df.withColumnRenamed("v", "w"), "id").select("id", (F.col("v") + F.col("w")).alias("v")))
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 6
    assert sorted(map(tuple, df.collect())) == [(k, k * 0.5 * 2**12) for k in range(100)] and df.dtypes == [("id", "bigint"), ("v", "double")]
    assert cut(df.where("id < 0")).count() == 0
