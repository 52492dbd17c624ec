"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

Sums of doubles depend on their order, so results of sums are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cloud, clustering, features, graph, neighbors, planes, stats, trees, voxel
from ..operators.session import cut
from ..sources import synthetic, tables
from . import compare, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CENTERS, R, K = 4, 0.1, 8
P, B, O = sql.PTS, sql.BULK, sql.ORDERS  # noqa: E741
BOX, HALF = (0.05, -0.05, 0.0), 0.15


def register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols})


def r6(*exprs: str) -> str:
    """SQL: round(expr, 6) + 0.0 AS name, from 'name' or 'expr AS name'."""
    parts = [e.rpartition(" AS ") if " AS " in e else (e, "", e) for e in exprs]
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for e, _, n in parts)


def near(*exprs: str, places: int = 4) -> str:
    """SQL as of ``r6``, to fewer places: eigenvectors lose some to close eigenvalues."""
    return r6(*exprs).replace(", 6)", f", {places})")


XYZ = ("x", "y", "z")
V = ("vx", "vy", "vz")

# --- projections, filters, aggregates --------------------------------------


@register(sql.query("SELECT point_id, x, y, z, label FROM pts", P))
def project_xyz(s, d):
    return cloud.project(tables.pts(s, d), "label")


@register(sql.query("SELECT point_id, x, y, z FROM pts WHERE y <= (SELECT min(y) FROM pts) + 0.2 AND z <= (SELECT min(z) FROM pts) + 0.2", P))
def roi_box_filter(s, d):
    return cloud.low_slab(tables.pts(s, d)).select("point_id", *XYZ)


@register(sql.query("SELECT point_id, x, y, z FROM pts WHERE x BETWEEN -0.1 AND 0.1 AND y >= 0.0 AND z <= 0.05", P))
def crop_box(s, d):
    return cloud.crop(tables.pts(s, d), (-0.1, 0.0, None), (0.1, None, 0.05)).select("point_id", *XYZ)


@register(sql.query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM bulk", B))
def bounds(s, d):
    return stats.bounds(tables.bulk(s, d))


@register(sql.query("SELECT min(x) + h AS cx, min(y) + h AS cy, min(z) + h AS cz, h AS half FROM bulk, (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2.0 AS h FROM bulk) GROUP BY h", B))
def octree_root_box(s, d):
    return stats.root_box(tables.bulk(s, d))


@register(sql.query(f"SELECT {r6('avg(x) AS mean_x', 'avg(y) AS mean_y', 'avg(z) AS mean_z')} FROM bulk", B))
def axis_mean(s, d):
    return rounded(stats.mean(tables.bulk(s, d)), *[f"mean_{c}" for c in XYZ])


@register(sql.query(f"SELECT {r6(*[f'covar_samp({c[0]}, {c[1]}) AS {c}' for c in sql.UPPER])} FROM bulk", B))
def covariance(s, d):
    return rounded(stats.covariance(tables.bulk(s, d)), *sql.UPPER)


@register(sql.query(f"SELECT {r6(*[f'corr({c[0]}, {c[1]}) AS {c}' for c in sql.UPPER])} FROM bulk", B))
def correlation(s, d):
    return rounded(stats.correlation(tables.bulk(s, d)), *sql.UPPER)


@register(sql.query(f"SELECT point_id, {r6(*[f'({c} - (SELECT avg({c}) FROM pts)) / (SELECT stddev_pop({c}) FROM pts) AS {c}' for c in XYZ])} FROM pts", P))
def standardize(s, d):
    return rounded(cloud.standardize(tables.pts(s, d)).select("point_id", *XYZ), *XYZ)


@register(sql.query(f"SELECT point_id, {r6('x * 0.6 + y * -0.4 AS x', 'x * -0.6 + y * 0.8 AS y')} FROM pts", P))
def shear(s, d):
    return rounded(cloud.transform(tables.pts(s, d), [[0.6, -0.6], [-0.4, 0.8]]).select("point_id", "x", "y"), "x", "y")


@register(sql.query("SELECT *, CAST(row_number() OVER (ORDER BY x, point_id) - 1 AS BIGINT) AS position FROM (SELECT point_id, x FROM pts)", P))
def sort_positions(s, d):
    return cloud.reindex(tables.pts(s, d).select("point_id", "x"), ["x", "point_id"])


@register(sql.query("SELECT point_id, x, y, z FROM pts WHERE point_id IN (SELECT event_id FROM events WHERE value > 50)", P))
def gather_by_id(s, d):
    ids = tables.read(s, d, "events").where("value > 50").select(F.col("event_id").alias("point_id"))
    return cloud.gather(tables.pts(s, d).select("point_id", *XYZ), ids)


@register(sql.query(f"SELECT label, {r6('sum(w * x) / sum(w) AS mean_x', 'sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)) AS var_x')} FROM (SELECT label, x, 1.0 + abs(y) AS w FROM pts) GROUP BY label", P))
def weighted_moments(s, d):
    w = stats.weighted(tables.pts(s, d).withColumn("w", 1.0 + F.abs("y")), "w", ["label"], ["x"])
    return rounded(w.select("label", "mean_x", "var_x"), "mean_x", "var_x")


@register(sql.query(f"SELECT b AS bin, n, {r6('n / sum(n) OVER () AS share')} FROM (SELECT {sql.bin_of('x', '1.0', '50.0', 7)} AS b, count(*) AS n FROM bulk GROUP BY b) WHERE b IS NOT NULL", B))
def histogram(s, d):
    return rounded(stats.histogram(tables.bulk(s, d), F.col("x"), 1.0, 50.0, 7), "share")


@register(sql.query("SELECT label, quantile_disc(x, 0.5) AS median FROM pts GROUP BY label", P))
def kd_lower_median(s, d):
    return stats.lower_median(tables.pts(s, d), "x", ["label"])


@register(sql.query(f"SELECT {r6('l1', 'l2', 'l3')} FROM eig", B, "cov AS (SELECT " + ", ".join(f"covar_samp({c[0]}, {c[1]}) AS {c}" for c in sql.UPPER) + " FROM bulk)", sql.eigen("cov")))
def pca_eigenvalues(s, d):
    return rounded(stats.scatter_eigenvalues(stats.covariance(tables.bulk(s, d))), "l1", "l2", "l3")


def _vectors(source: str) -> list[str]:
    return [sql.covariance(source), sql.eigen("cov"), *[sql.eigenvector("eig", f"l{k}", f"e{k}") for k in (1, 2, 3)]]


@register(sql.query(" UNION ALL ".join(f"SELECT {k} AS component, {near(f'l{k} AS eigenvalue', *V)} FROM e{k}" for k in (1, 2, 3)), B, *_vectors("bulk")))
def pca_components(s, d):
    return rounded(stats.pca(tables.bulk(s, d)), "eigenvalue", *V, places=4)


@register(sql.query(f"""SELECT point_id, {near('x', 'y', 'z', 'p1', 'p2', *[f'p1 * a{c} + p2 * b{c} AS r{c}' for c in XYZ])} FROM (
  SELECT c.*, a.vx AS ax, a.vy AS ay, a.vz AS az, b.vx AS bx, b.vy AS by_, b.vz AS bz, x * a.vx + y * a.vy + z * a.vz AS p1, x * b.vx + y * b.vy + z * b.vz AS p2 FROM centred c CROSS JOIN e1 a CROSS JOIN e2 b)""".replace("by AS ry", "by_ AS ry").replace("p2 * by,", "p2 * by_,"),
  P, "centred AS (SELECT point_id, " + ", ".join(f"{c} - (SELECT avg({c}) FROM pts) AS {c}" for c in XYZ) + " FROM pts)", *_vectors("centred")))
def pca_rebuild(s, d):
    p = cloud.centre(tables.pts(s, d).select("point_id", *XYZ))
    return rounded(stats.pca_project(p, stats.pca(p), 2), *XYZ, "p1", "p2", "rx", "ry", "rz", places=4)


# --- voxels -----------------------------------------------------------------

_CELL = "floor((x - (SELECT min(x) FROM {t})) / {l}) AS hx, floor((y - (SELECT min(y) FROM {t})) / {l}) AS hy, floor((z - (SELECT min(z) FROM {t})) / {l}) AS hz"
_MEANS = r6("avg(x) AS x", "avg(y) AS y", "avg(z) AS z")


@register(sql.query(f"SELECT CAST(hx AS BIGINT) AS hx, CAST(hy AS BIGINT) AS hy, CAST(hz AS BIGINT) AS hz, {_MEANS}, count(*) AS n_points FROM (SELECT *, {_CELL.format(t='bulk', l=5.0)} FROM bulk) GROUP BY ALL", B).replace("GROUP BY ALL", "GROUP BY hx, hy, hz"))
def voxel_centroid(s, d):
    return rounded(voxel.voxel_filter(tables.bulk(s, d), 5.0), *XYZ)


def _linear(form: str) -> str:
    dx, dy = (form.format(f"(max({c}) - min({c})) / 0.1") for c in "xy")
    return sql.query(f"SELECT CAST(h AS BIGINT) AS h, {_MEANS}, count(*) AS n_points FROM (SELECT x, y, z, floor(hx + hy * dx + hz * dx * dy) AS h FROM (SELECT *, {_CELL.format(t='pts', l=0.1)} FROM pts), (SELECT {dx} AS dx, {dy} AS dy FROM pts)) GROUP BY h", P)


@register(_linear("{}"))
def voxel_linear_float(s, d):
    return rounded(voxel.voxel_filter(tables.pts(s, d), 0.1, "linear_float"), *XYZ)


@register(_linear("ceil({})"))
def voxel_linear_ceil(s, d):
    return rounded(voxel.voxel_filter(tables.pts(s, d), 0.1, "linear_ceil"), *XYZ)


@register(sql.query(f"""SELECT slot, run, h, {_MEANS}, count(*) AS n_points FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY slot ORDER BY point_id) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN lag(h) OVER (PARTITION BY slot ORDER BY point_id) <> h THEN 1 ELSE 0 END AS new FROM (
      SELECT point_id, x, y, z, h, h % 20 AS slot FROM (
        SELECT *, CAST(floor(hx + hy * dx + hz * dx * dy) AS BIGINT) AS h FROM (SELECT *, {_CELL.format(t='pts', l=0.1)} FROM pts), (SELECT ceil((max(x) - min(x)) / 0.1) AS dx, ceil((max(y) - min(y)) / 0.1) AS dy FROM pts)))))
GROUP BY slot, run, h""", P))
def voxel_hashed_runs(s, d):
    return rounded(voxel.voxel_filter_hashed(tables.pts(s, d), 0.1, 20), *XYZ)


@register(sql.query(f"SELECT CAST(hx AS BIGINT) AS hx, CAST(hy AS BIGINT) AS hy, CAST(hz AS BIGINT) AS hz, point_id, x, y, z FROM (SELECT *, {_CELL.format(t='pts', l=0.1)} FROM pts) QUALIFY row_number() OVER (PARTITION BY hx, hy, hz ORDER BY ((point_id % 1000003) * 7919 + 104729) % 1000003, point_id) = 1", P))
def voxel_random_pick(s, d):
    return voxel.voxel_pick(tables.pts(s, d), 0.1)


# --- neighbours -------------------------------------------------------------


@register(sql.query("SELECT query_id, neighbor_id, dist, rank FROM ranked", P, sql.ranked(K)))
def knn_k8(s, d):
    return neighbors.knn_join(tables.pts(s, d), tables.pts(s, d), K)


@register(sql.query("SELECT query_id, neighbor_id, dist, rank FROM ranked", P, sql.ranked(K)))
def knn_brute_k8(s, d):
    return neighbors.knn_brute(tables.pts(s, d), tables.pts(s, d), K)


@register(sql.query("SELECT query_id, neighbor_id, dist, rank FROM ranked", P, sql.ranked(K, True)))
def knn_excl_self(s, d):
    return neighbors.knn_join(tables.pts(s, d), tables.pts(s, d), K, exclude_self=True)


@register("""SELECT query_id, neighbor_id, round(dist, 6) + 0.0 AS dist, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 8""")
def knn_vectors_k8(s, d):
    return rounded(neighbors.knn_vectors(tables.vec(s, d), tables.vec(s, d), K, exclude_self=True), "dist")


@register(sql.query("SELECT query_id, neighbor_id, dist FROM pairs", P, sql.pairs(R)))
def radius_pairs(s, d):
    return neighbors.radius_join(tables.pts(s, d), tables.pts(s, d), R)


@register(sql.query("SELECT query_id AS point_id, count(*) AS n FROM pairs GROUP BY query_id", P, sql.pairs(R)))
def radius_count(s, d):
    return neighbors.radius_count(tables.pts(s, d), R)


@register(sql.query(f"SELECT src, count(*) AS n, {r6('sum(d2) AS total', 'max(d2) AS top')} FROM (SELECT a.point_id AS src, {sql.D2} AS d2 FROM pts a CROSS JOIN pts b) GROUP BY src", P))
def pairwise_d2(s, d):
    p = neighbors.pairwise(tables.pts(s, d)).groupBy("src").agg(F.count("*").alias("n"), F.sum("d2").alias("total"), F.max("d2").alias("top"))
    return rounded(p, "total", "top")


def _predicate_sql() -> str:
    ax = {c: f"abs({c} - {v})" for c, v in zip(XYZ, BOX, strict=True)}
    over = " + ".join(f"greatest({v} - {HALF}, 0.0) * greatest({v} - {HALF}, 0.0)" for v in ax.values())
    far = " + ".join(f"({v} + {HALF}) * ({v} + {HALF})" for v in ax.values())
    faces = " + ".join(f"CAST({v} < {HALF} AS INTEGER)" for v in ax.values())
    apart = " OR ".join(f"{v} > {HALF} + {R}" for v in ax.values())
    slab = " + ".join(f"CAST({b} - {HALF} <= {c} + {R} AND {b} + {HALF} >= {c} AS INTEGER)" for c, b in zip(XYZ, BOX, strict=True))
    inside = " AND ".join(f"{v} + {R} < {HALF}" for v in ax.values())
    return sql.query(f"SELECT point_id, {inside} AS inside, NOT ({apart}) AND ({faces} >= 2 OR {over} < {R} * {R}) AS overlaps, {slab} >= 2 AS slab, sqrt({far}) < {R} AS contained, sqrt({far}) < 0.5 AS contained_wide FROM pts", P)


@register(_predicate_sql())
def octant_predicates(s, d):
    q, c, r, h = g.triple(), tuple(map(F.lit, BOX)), F.lit(R), F.lit(HALF)
    return tables.pts(s, d).select("point_id", g.ball_inside_box(q, r, c, h).alias("inside"), g.ball_overlaps_box(q, r, c, h).alias("overlaps"), g.slab_overlaps_box(q, r, c, h).alias("slab"), g.ball_contains_box(q, r, c, h).alias("contained"), g.ball_contains_box(q, F.lit(0.5), c, h).alias("contained_wide"))


@register(sql.query("SELECT point_id, path FROM walk WHERE depth = 3", P, sql.morton(3)))
def morton_code_l3(s, d):
    return trees.morton_paths(tables.pts(s, d), 3).select("point_id", "path")


# levels: half side about 0.4 on these points, so 0.03 is reached after four
@register(sql.query("""SELECT c.path, c.depth, c.n_points FROM counts c LEFT JOIN counts u ON u.path = substr(c.path, 1, c.depth - 1) AND u.depth = c.depth - 1
WHERE NOT (c.n_points > 32 AND c.half > 0.03) AND (c.depth = 0 OR (u.n_points > 32 AND u.half > 0.03))""", P, sql.morton(6), "counts AS (SELECT path, depth, max(half) AS half, count(*) AS n_points FROM walk GROUP BY path, depth)"))
def octree_leaves(s, d):
    return trees.octree_leaves(tables.pts(s, d), 32, 0.03)


@register(sql.query("SELECT * FROM leaves", P, sql.kdtree(32)))
def kdtree_leaves(s, d):
    return trees.kdtree_leaves(tables.pts(s, d), 32)


@register(sql.query("SELECT * FROM leaves", P, sql.kdtree(32, mean=True)))
def kdtree_leaves_mean(s, d):
    return trees.kdtree_leaves(tables.pts(s, d), 32, "mean")


@register(sql.query("SELECT CAST(max(depth) + 1 AS INTEGER) AS levels, count(*) AS leaves FROM leaves", P, sql.kdtree(32)))
def kdtree_depth(s, d):
    return trees.depth(trees.kdtree_leaves(tables.pts(s, d), 32))


# --- clusters ---------------------------------------------------------------


@register(sql.query("SELECT point_id, cluster FROM assigned", P, sql.lloyd(CENTERS, 0), sql.nearest("c0")))
def nearest_center(s, d):
    p = tables.pts(s, d)
    return clustering.Model(list(XYZ), clustering.first_rows(p, CENTERS)).predict(p).select("point_id", "cluster")


def _kmeans(s, d, rounds):
    p = cut(tables.pts(s, d))
    return clustering.kmeans(p, CENTERS, max_iter=rounds, tol=0.0).predict(p).select("point_id", "cluster")


@register(sql.query("SELECT point_id, cluster FROM assigned", P, sql.lloyd(CENTERS, 1), sql.nearest("c1")))
def kmeans_one_iter(s, d):
    return _kmeans(s, d, 1)


@register(sql.query("SELECT point_id, cluster FROM assigned", P, sql.lloyd(CENTERS, 3), sql.nearest("c3")))
def kmeans_3_iter(s, d):
    return _kmeans(s, d, 3)


@register(sql.query(f"SELECT point_id, {r6(*[f'sum(CASE WHEN k = {k} THEN w END) AS w{k}' for k in range(3)])} FROM resp GROUP BY point_id", P, sql.gmm(3)))
def gmm_e_step(s, d):
    p = tables.pts(s, d)
    return rounded(clustering.responsibilities(p, clustering.gmm_start(p, 3)).select("point_id", "w0", "w1", "w2"), "w0", "w1", "w2")


@register(sql.query(f"""SELECT r.k AS component, {r6('sum(w) / (SELECT sum(w) FROM resp) AS weight', *[f'max(m{c}) AS mean_{c}' for c in XYZ], *[f'sum(w * ({c} - m{c}) * ({c} - m{c})) / sum(w) AS var_{c}' for c in XYZ])}
FROM resp r JOIN (SELECT k, {', '.join(f'sum(w * {c}) / sum(w) AS m{c}' for c in XYZ)} FROM resp GROUP BY k) m ON m.k = r.k GROUP BY r.k""", P, sql.gmm(3)))
def gmm_one_iter(s, d):
    p = tables.pts(s, d)
    return _model_rows(s, clustering.gmm_step(p, clustering.gmm_start(p, 3)))


def _model_rows(s, m):
    rows = [(k, m.weights[k], *m.centers[k], *m.variances[k]) for k in range(len(m.centers))]
    names = ["weight", *[f"mean_{c}" for c in m.cols], *[f"var_{c}" for c in m.cols]]
    return rounded(s.createDataFrame(rows, "component int, " + ", ".join(f"{n} double" for n in names)), *names)


@register()
def gmm_50(s, d):
    p = cut(tables.pts(s, d))
    return clustering.gmm_diag(p, 3).predict(p).select("point_id", "cluster")


@register(sql.query(f"SELECT src, dst, {r6('w')} FROM edges", P, sql.knn_edges(K)))
def knn_graph_sym(s, d):
    return rounded(neighbors.knn_graph(tables.pts(s, d), K), "w")


@register(sql.query("SELECT src, dst, sum(0.5) AS w FROM (SELECT query_id AS src, neighbor_id AS dst FROM ranked UNION ALL SELECT neighbor_id, query_id FROM ranked) GROUP BY src, dst", P, sql.ranked(K, True)).replace("sum(0.5)", "CAST(sum(0.5) AS DOUBLE)"))
def knn_graph_averaged(s, d):
    near = neighbors.knn_join(tables.pts(s, d), tables.pts(s, d), K, exclude_self=True)
    return graph.averaged(near.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst")))


@register(sql.query(f"SELECT src, {r6('sum(w) AS degree')} FROM edges GROUP BY src", P, sql.knn_edges(K)))
def graph_degree(s, d):
    return rounded(graph.degree(neighbors.knn_graph(tables.pts(s, d), K)), "degree")


@register(sql.query(f"SELECT e.src, dst, {r6('-w / degree AS l')} FROM edges e JOIN deg USING (src) UNION ALL SELECT src, src, 1.0 FROM deg", P, sql.knn_edges(K), "deg AS (SELECT src, sum(w) AS degree FROM edges GROUP BY src)"))
def laplacian_rw_edges(s, d):
    return rounded(graph.random_walk_laplacian(neighbors.knn_graph(tables.pts(s, d), K)), "l")


@register()
def spectral_labels(s, d):
    return clustering.spectral(tables.pts(s, d), 4)


DB_R, DB_N = 0.04, 4


@register(sql.query(f"SELECT query_id AS point_id, count(*) AS n FROM pairs GROUP BY query_id HAVING count(*) >= {DB_N}", P, sql.pairs(DB_R)))
def dbscan_core(s, d):
    return neighbors.radius_count(tables.pts(s, d), DB_R).where(F.col("n") >= DB_N)


@register(sql.query("""SELECT p.point_id, core.point_id IS NOT NULL AS is_core, coalesce(lab.label, near.label, -1) AS cluster
FROM pts p LEFT JOIN core USING (point_id) LEFT JOIN lab USING (point_id)
LEFT JOIN (SELECT query_id AS point_id, min(label) AS label FROM pairs JOIN lab ON lab.point_id = neighbor_id GROUP BY query_id) near USING (point_id)""", P, sql.pairs(DB_R),
f"core AS (SELECT query_id AS point_id FROM pairs GROUP BY query_id HAVING count(*) >= {DB_N})",
"inner_ AS (SELECT query_id AS a, neighbor_id AS b FROM pairs JOIN core c ON c.point_id = query_id JOIN core e ON e.point_id = neighbor_id)",
"reach AS (SELECT point_id AS a, point_id AS b FROM core UNION SELECT r.a, i.b FROM reach r JOIN inner_ i ON i.a = r.b)",
"lab AS (SELECT a AS point_id, min(b) AS label FROM reach GROUP BY a)"))
def dbscan_labels(s, d):
    return clustering.dbscan(tables.pts(s, d), DB_R, DB_N)


@register(sql.query("SELECT point_id, CAST(CASE WHEN label < 0 THEN 9 ELSE label % 9 END AS INTEGER) AS colour FROM pts", P))
def cluster_colour(s, d):
    return tables.pts(s, d).select("point_id", g.palette(F.col("label")).alias("colour"))


# --- planes -----------------------------------------------------------------

TAO, ITERS = 5.0, 35


@register(sql.query("SELECT point_id, abs(0.2 * x + -0.3 * y + 0.9 * z + 0.05) / sqrt(0.2 * 0.2 + -0.3 * -0.3 + 0.9 * 0.9) AS dist FROM pts", P))
def plane_distance(s, d):
    return tables.pts(s, d).select("point_id", g.plane_distance(g.triple(), *map(F.lit, (0.2, -0.3, 0.9, 0.05))).alias("dist"))


@register(sql.query(f"SELECT iter, {r6('nx', 'ny', 'nz')}, inliers FROM scores", O, sql.hypotheses("op", ITERS), sql.scores("op", TAO)))
def ransac_scores(s, d):
    p = tables.order_points(s, d)
    return rounded(planes.ransac_scores(p, planes.hypotheses(p, ITERS), TAO).select("iter", "nx", "ny", "nz", "inliers"), "nx", "ny", "nz")


@register(sql.query(f"SELECT iter, {r6('nx', 'ny', 'nz', 'px', 'py', 'pz')}, inliers FROM scores_best", O, sql.hypotheses("op", ITERS), sql.scores("op", TAO)))
def ransac_best(s, d):
    return rounded(planes.ransac_plane(tables.order_points(s, d), TAO, ITERS), "nx", "ny", "nz", "px", "py", "pz")


@register(sql.query(f"SELECT point_id, {r6('pd AS plane_dist')}, pd < {TAO} AS is_ground FROM (SELECT point_id, abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) AS pd FROM op CROSS JOIN scores_best)", O, sql.hypotheses("op", ITERS), sql.scores("op", TAO)))
def ground_split(s, d):
    return rounded(planes.ground_split(tables.order_points(s, d), "ransac", TAO, ITERS).select("point_id", "plane_dist", "is_ground"), "plane_dist")


@register(sql.query(f"SELECT * FROM (SELECT 0 AS pass, point_id, abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) < {TAO} AS is_ground FROM op CROSS JOIN s0_best UNION ALL SELECT 1, point_id, abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) < {TAO} FROM op CROSS JOIN s1_best)", O, sql.hypotheses("op", ITERS, 0, "h0"), sql.hypotheses("op", ITERS, 1, "h1"), sql.scores("op", TAO, "h0", "s0"), sql.scores("op", TAO, "h1", "s1")))
def ground_two_pass(s, d):
    p = tables.order_points(s, d)
    return cloud.stack(*[planes.ground_split(p, "ransac", TAO, ITERS, k) for k in (0, 1)], tag="pass").select("pass", "point_id", "is_ground")


_SAMPLE = f"sample AS (SELECT CAST((hx * 2097152 + hy) * 2097152 + hz AS BIGINT) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT *, {_CELL.format(t='op', l=10.0)} FROM op) GROUP BY hx, hy, hz)"
_PASSES = [x for k in (0, 1) for x in (sql.hypotheses("sample", ITERS, k, f"h{k}"), sql.scores("sample", TAO, f"h{k}", f"s{k}"))]


@register(sql.query(" UNION ALL ".join(f"SELECT {k} AS pass, is_ground, count(*) AS n FROM (SELECT abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) < {TAO} AS is_ground FROM op CROSS JOIN s{k}_best) GROUP BY is_ground" for k in (0, 1)), O, _SAMPLE, *_PASSES))
def ground_passes_voxel(s, d):
    return planes.ground_passes(tables.order_points(s, d), 10.0, TAO, ITERS).groupBy("pass", "is_ground").agg(F.count("*").alias("n"))


_PLANE = "SELECT vx AS a, vy AS b, vz AS c, -(vx * mx + vy * my + vz * mz) AS d FROM e3"
_MID = ", avg(x) AS mx, avg(y) AS my, avg(z) AS mz"


@register(sql.query(f"SELECT {near('a', 'b', 'c', 'd')} FROM ({_PLANE})", P, sql.covariance("pts", more=_MID), sql.eigen("cov"), sql.eigenvector("eig", "l3", "e3")))
def lsq_plane(s, d):
    return rounded(planes.lsq_plane(tables.pts(s, d)), "a", "b", "c", "d", places=4)


@register(sql.query(f"SELECT point_id, abs(a * x + b * y + c * z + d) / sqrt(a * a + b * b + c * c) < 0.05 AS is_ground FROM pts CROSS JOIN ({_PLANE})", P, sql.hypotheses("pts", ITERS), sql.scores("pts", 0.05),
"inliers AS (SELECT pts.* FROM pts CROSS JOIN scores_best WHERE abs((x - px) * nx_ + (y - py) * ny_ + (z - pz) * nz_) < 0.05)".replace("scores_best", "(SELECT nx AS nx_, ny AS ny_, nz AS nz_, px, py, pz FROM scores_best)"),
sql.covariance("inliers", more=_MID), sql.eigen("cov"), sql.eigenvector("eig", "l3", "e3")))
def ground_lsq(s, d):
    return planes.ground_split(tables.pts(s, d), "ransac_lsq", 0.05).select("point_id", "is_ground")


# --- features ---------------------------------------------------------------

ISS_R, ISS_T = 0.2, 0.4


@register(sql.query(f"SELECT point_id, {r6(*sql.UPPER)} FROM scatter", P, sql.scatter(ISS_R)))
def iss_scatter(s, d):
    return rounded(features.weighted_scatter(tables.pts(s, d), ISS_R), *sql.UPPER)


@register(sql.query(f"SELECT point_id, {r6('l1', 'l2', 'l3')} FROM eig", P, sql.scatter(ISS_R), sql.eigen("scatter")))
def iss_eigenvalues(s, d):
    return rounded(stats.scatter_eigenvalues(features.weighted_scatter(tables.pts(s, d), ISS_R), ["point_id"]), "l1", "l2", "l3")


@register(sql.query(f"SELECT point_id, {r6('l3 AS score')} FROM eig WHERE l1 * 0.875 > l2 AND l2 * 0.875 > l3", P, sql.scatter(ISS_R), sql.eigen("scatter")))
def iss_salient(s, d):
    return rounded(features.salient(tables.pts(s, d), ISS_R).select("point_id", F.col("l3").alias("score")), "score")


@register(sql.query(f"SELECT point_id, {r6('score')}, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS order FROM good JOIN chosen USING (i)".replace("AS order", 'AS "order"'), P, sql.scatter(ISS_R), sql.eigen("scatter"), sql.keypoints(ISS_R, g.iou_radius(ISS_R, ISS_T))))
def iss_keypoints(s, d):
    return rounded(features.iss_keypoints(tables.pts(s, d), ISS_R, ISS_T), "score")


@register(sql.query(f"SELECT query_id, neighbor_id, {r6('CASE WHEN dist = 0 THEN 1.0 WHEN dist >= 0.2 THEN 0.0 ELSE f / (2.0 - f) END AS iou')} FROM (SELECT *, (1.0 - dist / 0.2) * (1.0 - dist / 0.2) * (2.0 + dist / 0.2) / 2.0 AS f FROM pairs)", P, sql.pairs(R)))
def sphere_iou_pairs(s, d):
    p = neighbors.radius_join(tables.pts(s, d), tables.pts(s, d), R)
    return rounded(p.select("query_id", "neighbor_id", g.sphere_iou(F.col("dist"), R).alias("iou")), "iou")


@register(sql.query(f"SELECT query_id, neighbor_id, {r6('alpha', 'phi', 'theta')} FROM angles", P, sql.angles(R)))
def fpfh_angles(s, d):
    return rounded(features.pair_angles(tables.pts(s, d), R).drop("dist"), "alpha", "phi", "theta")


@register(sql.query(f"SELECT point_id AS key_idx, CAST(c AS INTEGER) AS index, {r6('v AS feature')} FROM spfh", P, sql.spfh(R, 6)))
def spfh_histogram(s, d):
    return rounded(features.descriptor_rows(features.spfh(tables.pts(s, d), R, 6)), "feature")


@register(sql.query(f"""SELECT point_id AS key_idx, CAST(c AS INTEGER) AS index, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY point_id)) AS feature')} FROM (
  SELECT s.point_id, s.c, s.v + m.t / n.n AS v FROM spfh s
  JOIN (SELECT a.query_id AS point_id, o.c, sum(o.v / a.dist) AS t FROM angles a JOIN spfh o ON o.point_id = a.neighbor_id GROUP BY a.query_id, o.c) m ON m.point_id = s.point_id AND m.c = s.c
  JOIN (SELECT query_id AS point_id, count(*) AS n FROM angles GROUP BY query_id) n ON n.point_id = s.point_id)""", P, sql.spfh(R, 6)))
def fpfh(s, d):
    return rounded(features.descriptor_rows(features.fpfh(tables.pts(s, d), R, 6)), "feature")


def _normals(source: str, where: str) -> str:
    """Normals from the covariance of each query's neighbours."""
    return sql.query(f"SELECT point_id, {near('vx AS nx', 'vy AS ny', 'vz AS nz')} FROM e3", P, source, f"around AS (SELECT r.query_id AS point_id, p.x, p.y, p.z FROM {where} r JOIN pts p ON p.point_id = r.neighbor_id)", sql.covariance("around", "point_id", "every_cov"), "cov AS (SELECT * FROM every_cov WHERE xx IS NOT NULL)", sql.eigen("cov"), sql.eigenvector("eig", "l3", "e3"))


@register(_normals(sql.ranked(200), "ranked"))
def normals(s, d):
    return rounded(features.normals(tables.pts(s, d), 200), "nx", "ny", "nz", places=4)


@register(_normals(sql.pairs(0.2), "pairs"))
def normals_radius(s, d):
    return rounded(features.normals(tables.pts(s, d), r=0.2), "nx", "ny", "nz", places=4)


@register(sql.query(f"""SELECT point_id AS key_idx, CAST(c AS INTEGER) AS index, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY point_id)) AS feature')} FROM (
  SELECT s.point_id, s.c, s.v + m.t / n.n AS v FROM spfh s
  JOIN (SELECT a.query_id AS point_id, o.c, sum(o.v / a.dist) AS t FROM angles a JOIN spfh o ON o.point_id = a.neighbor_id GROUP BY a.query_id, o.c) m ON m.point_id = s.point_id AND m.c = s.c
  JOIN (SELECT query_id AS point_id, count(*) AS n FROM angles GROUP BY query_id) n ON n.point_id = s.point_id)
WHERE point_id IN (SELECT point_id FROM good JOIN chosen USING (i)) AND point_id IN (SELECT point_id FROM pts WHERE y <= (SELECT min(y) FROM pts) + 0.5 AND z <= (SELECT min(z) FROM pts) + 0.5)""",
P, sql.scatter(ISS_R), sql.eigen("scatter"), sql.keypoints(ISS_R, g.iou_radius(ISS_R, ISS_T)), sql.spfh(0.2, 6)))
def describe_keypoints(s, d):
    p = tables.pts(s, d)
    return rounded(features.describe(p, features.iss_keypoints(p, ISS_R, ISS_T), height=0.5), "feature")


# --- generated sets -----------------------------------------------------------


@register(f"SELECT point_id, {r6(*[f'{sql.uniform(10 + k)} AS {c}' for k, c in enumerate(XYZ)])} FROM {sql.ids(64_000)}")
def synthetic_cube(s, d):
    return rounded(synthetic.cube(s, 64_000), *XYZ)


@register(f"""SELECT point_id, {r6(*[f"{sql.gaussian(k)} * sqrt(CASE c WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} ELSE {v[2]} END) + CASE c WHEN 0 THEN {m[0]} WHEN 1 THEN {m[1]} ELSE {m[2]} END AS {a}" for k, (a, v, m) in enumerate((('x', (1.0, 2.0, 6.0), (0.5, 5.5, 1.0)), ('y', (3.0, 2.0, 2.0), (0.5, 2.5, 7.0))))])}, c AS component
FROM (SELECT *, CAST(point_id >= 400 AS INTEGER) + CAST(point_id >= 1000 AS INTEGER) AS c FROM {sql.ids(2000)})""")
def synthetic_gaussians(s, d):
    return rounded(synthetic.gaussians(s), "x", "y")


_SHAPES = ("circles", "moons", "blobs", "uniform", "sheared", "varied")


@register(" UNION ALL ".join(f"SELECT {k} AS shape, point_id, {r6('x', 'y')}, part FROM ({sql.shape(kind)})" for k, kind in enumerate(_SHAPES)))
def synthetic_shapes(s, d):
    kinds = _SHAPES
    return rounded(cloud.stack(*[synthetic.shapes(s, k).select("point_id", "x", "y", "part") for k in kinds], tag="shape"), "x", "y")


@register(sql.query(f"SELECT draw, pts.point_id, x, y, z FROM (SELECT point_id AS draw, CAST(floor({sql.uniform(0)} * (SELECT count(*) FROM pts)) AS BIGINT) AS pick FROM {sql.ids(1000)}) JOIN pts ON pts.point_id = pick", P))
def sampled_rows(s, d):
    return synthetic.sample_rows(tables.pts(s, d).select("point_id", *XYZ), 1000)


@register()
def clustering_compare(s, d):
    return compare.compare(s, ("spectral", "kmeans"))[0].groupBy("shape", "method", "cluster").agg(F.count("*").alias("n"))
