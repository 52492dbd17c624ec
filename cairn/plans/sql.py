"""SQL pieces of the oracle queries (DuckDB)."""

from __future__ import annotations

PTS = """pts AS (
  SELECT point_id, x, y, z, a / len AS nx, b / len AS ny, c / len AS nz, label FROM (
    SELECT *, sqrt(a * a + b * b + c * c) AS len FROM (
      SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
             CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b,
             CAST(embedding[6] AS DOUBLE) AS c, label FROM embeddings)))"""
BULK = "bulk AS (SELECT l_quantity AS x, l_extendedprice / 1000.0 AS y, l_discount * 100.0 AS z FROM lineitem)"
ORDERS = """op AS (
  SELECT o_orderkey AS point_id, o_custkey / 100.0 AS x, o_totalprice / 10000.0 AS y,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 10.0 AS z FROM orders)"""
D2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
UPPER = ("xx", "xy", "xz", "yy", "yz", "zz")


def query(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


def pairs(r: float, table: str = "pts") -> str:
    return f"pairs AS (SELECT a.point_id AS query_id, b.point_id AS neighbor_id, sqrt{D2} AS dist, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM {table} a JOIN {table} b ON sqrt{D2} <= {r})"


def ranked(k: int, exclude_self: bool = False) -> str:
    skip = "WHERE a.point_id <> b.point_id" if exclude_self else ""
    return f"""ranked AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS INTEGER) AS rank
    FROM (SELECT a.point_id AS query_id, b.point_id AS neighbor_id, sqrt{D2} AS dist FROM pts a CROSS JOIN pts b {skip})) WHERE rank <= {k})"""


def eigen(source: str) -> str:
    """Eigenvalues l1 >= l2 >= l3 of the symmetric matrices in a table's columns xx .. zz."""
    return f"""eig0 AS (SELECT *, (xx + yy + zz) / 3.0 AS q FROM {source}),
eig1 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0) AS p,
  (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det FROM eig0),
eig2 AS (SELECT *, acos(greatest(-1.0, least(1.0, CASE WHEN p > 0 THEN det / (2.0 * p * p * p) ELSE 0.0 END))) / 3.0 AS phi FROM eig1),
eig3 AS (SELECT *, q + 2.0 * p * cos(phi) AS l1, q + 2.0 * p * cos(phi + 2.0 * pi() / 3.0) AS l3 FROM eig2),
eig AS (SELECT *, 3.0 * q - l1 - l3 AS l2 FROM eig3)"""


def scatter(r: float) -> str:
    cells = ", ".join(f"sum(w * d{c[0]} * d{c[1]}) / sum(w) AS {c}" for c in UPPER)
    return f"""{pairs(r)},
counts AS (SELECT query_id AS neighbor_id, 1.0 / count(*) AS w FROM pairs GROUP BY query_id),
scatter AS (SELECT query_id AS point_id, {cells} FROM pairs JOIN counts USING (neighbor_id) GROUP BY query_id)"""


def nearest(centers: str, source: str = "pts", label: str = "assigned") -> str:
    return f"""{label} AS (SELECT point_id, x, y, z, cluster FROM (SELECT a.*, b.k AS cluster, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt{D2}, b.k) AS rn
  FROM {source} a CROSS JOIN {centers} b) WHERE rn = 1)"""


def lloyd(k: int, rounds: int) -> str:
    out = [f"c0 AS (SELECT CAST(point_id AS INTEGER) AS k, x, y, z FROM pts WHERE point_id < {k})"]
    for i in range(rounds):
        out.append(nearest(f"c{i}", label=f"a{i}"))
        out.append(f"c{i + 1} AS (SELECT c.k, coalesce(n.x, c.x) AS x, coalesce(n.y, c.y) AS y, coalesce(n.z, c.z) AS z FROM c{i} c LEFT JOIN (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a{i} GROUP BY cluster) n ON n.cluster = c.k)")
    return ", ".join(out)


def gmm(k: int) -> str:
    """Responsibilities with the first k points as means, unit variances and equal weights."""
    return f"""mix AS (
  SELECT a.point_id, a.x, a.y, a.z, CAST(b.point_id AS INTEGER) AS k, ln(1.0 / {k}) - 1.5 * ln(2 * pi()) - (a.x - b.x) * (a.x - b.x) / 2.0 - (a.y - b.y) * (a.y - b.y) / 2.0 - (a.z - b.z) * (a.z - b.z) / 2.0 AS l
  FROM pts a CROSS JOIN (SELECT * FROM pts WHERE point_id < {k}) b),
resp AS (SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY point_id) AS w FROM mix)"""


def knn_edges(k: int) -> str:
    return f"""{ranked(k, True)},
edges AS (SELECT src, dst, exp(-(d * d) / 2.0) AS w FROM (
  SELECT query_id AS src, neighbor_id AS dst, dist AS d FROM ranked UNION SELECT neighbor_id, query_id, dist FROM ranked))"""


def hypotheses(table: str, n: int, seed: int = 0, label: str = "hyp") -> str:
    return f"""{label}_s AS (SELECT *, row_number() OVER (ORDER BY o, point_id) - 1 AS k FROM (
    SELECT *, ((point_id % 1000003) * 7919 + {104729 * (seed + 1)}) % 1000003 AS o FROM {table}) QUALIFY k < {3 * n}),
{label}_t AS (SELECT CAST(floor(p.k / 3) AS INTEGER) AS iter, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, r.x - p.x AS bx, r.y - p.y AS by_, r.z - p.z AS bz
  FROM {label}_s p JOIN {label}_s q ON q.k = p.k + 1 JOIN {label}_s r ON r.k = p.k + 2 WHERE p.k % 3 = 0),
{label}_c AS (SELECT *, ay * bz - az * by_ AS mx, az * bx - ax * bz AS my, ax * by_ - ay * bx AS mz FROM {label}_t),
{label} AS (SELECT iter, mx / len AS nx, my / len AS ny, mz / len AS nz, px, py, pz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS len FROM {label}_c) WHERE len > 0)"""


def scores(table: str, tao: float, hyp: str = "hyp", label: str = "scores") -> str:
    return f"""{label} AS (SELECT h.*, (SELECT count(*) FROM {table} p WHERE abs((p.x - h.px) * h.nx + (p.y - h.py) * h.ny + (p.z - h.pz) * h.nz) < {tao}) AS inliers FROM {hyp} h),
{label}_best AS (SELECT * FROM {label} WHERE inliers > 2 ORDER BY inliers DESC, iter LIMIT 1)"""


def angles(r: float) -> str:
    """Pair angles of points with normals."""
    return f"""near AS (SELECT a.point_id AS query_id, b.point_id AS neighbor_id, sqrt{D2} AS dist, a.nx AS ux, a.ny AS uy, a.nz AS uz, b.nx AS ox, b.ny AS oy, b.nz AS oz,
  b.x - a.x AS ex, b.y - a.y AS ey, b.z - a.z AS ez FROM pts a JOIN pts b ON a.point_id <> b.point_id AND sqrt{D2} <= {r} AND sqrt{D2} > 0),
dir AS (SELECT *, ex / dist AS dx, ey / dist AS dy, ez / dist AS dz FROM near),
vs AS (SELECT *, uy * dz - uz * dy AS vx, uz * dx - ux * dz AS vy, ux * dy - uy * dx AS vz FROM dir),
ws AS (SELECT *, uy * vz - uz * vy AS wx, uz * vx - ux * vz AS wy, ux * vy - uy * vx AS wz FROM vs),
angles AS (SELECT query_id, neighbor_id, dist, vx * ox + vy * oy + vz * oz AS alpha, ux * dx + uy * dy + uz * dz AS phi,
  atan2(wx * ox + wy * oy + wz * oz, ux * ox + uy * oy + uz * oz) AS theta FROM ws)"""


def bin_of(v: str, lo: str, hi: str, bins: int) -> str:
    return f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN least(CAST(floor(({v} - {lo}) * {bins} / ({hi} - {lo})) AS INTEGER), {bins - 1}) END"


def spfh(r: float, bins: int) -> str:
    """Histogram cells: point_id, c (0 .. 3 * bins - 1), v."""
    parts = []
    for k, (name, lo, hi) in enumerate((("alpha", "-1.0", "1.0"), ("phi", "-1.0", "1.0"), ("theta", "(-pi())", "pi()"))):
        parts.append(f"SELECT query_id, {k} AS h, {bin_of(name, lo, hi, bins)} AS b FROM angles")
    return f"""{angles(r)},
binned AS ({' UNION ALL '.join(parts)}),
cells AS (SELECT query_id AS point_id, h * {bins} + b AS c, count(*) / sum(count(*)) OVER (PARTITION BY query_id, h) AS v FROM binned WHERE b IS NOT NULL GROUP BY query_id, h, b),
spfh AS (SELECT p.point_id, g.c, coalesce(s.v, 0.0) AS v FROM (SELECT DISTINCT query_id AS point_id FROM angles) p CROSS JOIN (SELECT unnest(range({3 * bins})) AS c) g LEFT JOIN cells s ON s.point_id = p.point_id AND s.c = g.c)"""


def morton(levels: int) -> str:
    child = "(CASE WHEN x > cx THEN 1 ELSE 0 END + CASE WHEN y > cy THEN 2 ELSE 0 END + CASE WHEN z > cz THEN 4 ELSE 0 END)"
    move = ", ".join(f"c{c} + CASE WHEN {c} > c{c} THEN half / 2.0 ELSE -half / 2.0 END" for c in "xyz")
    return f"""root AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2.0 AS half, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts),
walk AS (
  SELECT point_id, x, y, z, lx + half AS cx, ly + half AS cy, lz + half AS cz, half, '' AS path, 0 AS depth FROM pts CROSS JOIN root
  UNION ALL
  SELECT point_id, x, y, z, {move}, half / 2.0, path || CAST({child} AS VARCHAR), depth + 1 FROM walk WHERE depth < {levels})"""


def eigenvector(source: str, value: str, label: str) -> str:
    """Unit eigenvectors vx, vy, vz to the column ``value`` of the matrices xx .. zz, their largest component positive: the longest cross product of two rows."""
    cross = {"p": ("xy * yz - xz * b2", "xz * xy - a1 * yz", "a1 * b2 - xy * xy"), "q": ("xy * c3 - xz * yz", "xz * xz - a1 * c3", "a1 * yz - xy * xz"), "r": ("b2 * c3 - yz * yz", "yz * xz - xy * c3", "xy * yz - b2 * xz")}
    cells = ", ".join(f"{e} AS {n}{k}" for n, three in cross.items() for k, e in enumerate(three, 1))
    lengths = ", ".join(f"{n}1 * {n}1 + {n}2 * {n}2 + {n}3 * {n}3 AS n{n}" for n in cross)
    pick = ", ".join(f"CASE WHEN np >= nq AND np >= nr THEN p{k} WHEN nq >= nr THEN q{k} ELSE r{k} END / sqrt(greatest(np, nq, nr)) AS u{k}" for k in (1, 2, 3))
    g = [f"abs(round(u{k}, 12))" for k in (1, 2, 3)]
    sign = f"CASE WHEN CASE WHEN {g[0]} >= {g[1]} AND {g[0]} >= {g[2]} THEN u1 WHEN {g[1]} >= {g[2]} THEN u2 ELSE u3 END < 0 THEN -1.0 ELSE 1.0 END"
    return f"""{label}_m AS (SELECT *, xx - {value} AS a1, yy - {value} AS b2, zz - {value} AS c3 FROM {source}),
{label}_c AS (SELECT *, {cells} FROM {label}_m),
{label}_n AS (SELECT *, {lengths} FROM {label}_c),
{label}_u AS (SELECT *, {pick} FROM {label}_n),
{label} AS (SELECT * EXCLUDE (a1, b2, c3, p1, p2, p3, q1, q2, q3, r1, r2, r3, np, nq, nr, u1, u2, u3), u1 * ({sign}) AS vx, u2 * ({sign}) AS vy, u3 * ({sign}) AS vz FROM {label}_u)"""


def covariance(source: str, by: str = "", label: str = "cov", more: str = "") -> str:
    cells = ", ".join(f"covar_samp({c[0]}, {c[1]}) AS {c}" for c in UPPER)
    return f"{label} AS (SELECT {by + ', ' if by else ''}{cells}{more} FROM {source}{' GROUP BY ' + by if by else ''})"


def kdtree(leaf_size: int, mean: bool = False) -> str:
    """Leaves of the kd-tree over pts: every point walks down while its node splits; the deepest node of a point is its leaf."""
    low = [f"quantile_disc({c}, 0.5) OVER (PARTITION BY path) AS l{k}, max({c}) OVER (PARTITION BY path) AS t{k}" for k, c in enumerate("xyz")]
    turn = " ".join(f"WHEN l{(t + s) % 3} < t{(t + s) % 3} AND turn = {t} AND n > {leaf_size} THEN {(t + s) % 3}" for s in range(3) for t in range(3))
    at = lambda names: f"CASE a {' '.join(f'WHEN {k} THEN {n}' for k, n in enumerate(names))} END"
    # the element after the median: the least above it
    above = f"min(CASE WHEN v > low THEN v END) OVER (PARTITION BY path)" if mean else "low"
    return f"""walk AS (
  SELECT point_id, x, y, z, '' AS path, CAST(NULL AS INTEGER) AS axis, CAST(NULL AS DOUBLE) AS value, 0 AS turn FROM pts
  UNION ALL
  SELECT point_id, x, y, z, path || CASE WHEN v <= (low + up) / 2.0 THEN '0' ELSE '1' END, a, (low + up) / 2.0, (a + 1) % 3 FROM (
    SELECT *, {above} AS up FROM (
      SELECT *, {at('xyz')} AS v, {at(('l0', 'l1', 'l2'))} AS low FROM (
        SELECT *, CASE {turn} END AS a FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, {', '.join(low)} FROM walk)) WHERE a IS NOT NULL))),
leaf AS (SELECT point_id, max(length(path)) AS depth FROM walk GROUP BY point_id),
leaves AS (SELECT path, depth, count(*) AS n_points, any_value(axis) AS axis, any_value(value) AS value FROM walk JOIN leaf USING (point_id) WHERE length(path) = depth GROUP BY path, depth)"""


def keypoints(r: float, reach: float) -> str:
    """Greedy choice among the salient points of ``eig`` by falling (score, id), one a step, with the list of those kept so far."""
    return f"""good AS (SELECT point_id, l3 AS score, row_number() OVER (ORDER BY l3 DESC, point_id DESC) AS i FROM eig WHERE l1 * 0.875 > l2 AND l2 * 0.875 > l3),
foes AS (SELECT g.i, list(h.i) AS f FROM good g JOIN pairs p ON p.query_id = g.point_id JOIN good h ON h.point_id = p.neighbor_id WHERE h.i < g.i AND p.dist < {reach!r} GROUP BY g.i),
steps AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT g.i, CASE WHEN list_has_any(s.kept, coalesce(f.f, [])) THEN s.kept ELSE list_append(s.kept, g.i) END FROM steps s JOIN good g ON g.i = s.i + 1 LEFT JOIN foes f ON f.i = g.i),
chosen AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM steps ORDER BY i DESC LIMIT 1))"""


def uniform(stream: int, seed: int = 0) -> str:
    """A number in (0, 1) from point_id."""
    h = f"((point_id % 2147483647) * 48271 + {stream * 69621 + seed * 16807 + 12345}) % 2147483647"
    for factor in (48271, 69621):
        h = f"(({h}) * ({h}) + ({h}) * {factor} + 11) % 2147483647"
    return f"((CAST({h} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(2147483647 AS DOUBLE))"


def gaussian(stream: int) -> str:
    return f"(sqrt(-2.0 * ln({uniform(2 * stream)})) * cos(2.0 * pi() * {uniform(2 * stream + 1)}))"


def ids(n: int) -> str:
    return f"(SELECT CAST(range AS BIGINT) AS point_id FROM range({n}))"


def shape(kind: str, n: int = 1500) -> str:
    """point_id, x, y, part of a comparison set."""
    half = n // 2
    e, t = [f"{gaussian(k)} * 0.05" for k in (0, 1)], f"CASE WHEN point_id < {half} THEN point_id / CAST({half} AS DOUBLE) ELSE (point_id - {half}) / CAST({n - half} AS DOUBLE) END"
    part = f"CAST(point_id >= {half} AS INTEGER)"
    if kind == "circles":
        return f"SELECT point_id, r * cos(a) + e AS x, r * sin(a) + f AS y, part FROM (SELECT point_id, CASE WHEN point_id < {half} THEN 1.0 ELSE 0.5 END AS r, ({t}) * 2.0 * pi() AS a, {e[0]} AS e, {e[1]} AS f, {part} AS part FROM {ids(n)})"
    if kind == "moons":
        return f"SELECT point_id, CASE WHEN part = 0 THEN cos(a) ELSE 1.0 - cos(a) END + e AS x, CASE WHEN part = 0 THEN sin(a) ELSE 0.5 - sin(a) END + f AS y, part FROM (SELECT point_id, ({t}) * pi() AS a, {e[0]} AS e, {e[1]} AS f, {part} AS part FROM {ids(n)})"
    if kind == "uniform":
        return f"SELECT point_id, {uniform(10)} AS x, {uniform(11)} AS y, 0 AS part FROM {ids(n)}"
    pick = lambda a: f"CASE point_id % 3 WHEN 0 THEN {a[0]} WHEN 1 THEN {a[1]} ELSE {a[2]} END"
    wide = pick((1.0, 2.5, 0.5)) if kind == "varied" else "1.0"
    out = f"SELECT point_id, {gaussian(0)} * ({wide}) + ({pick((-7.0, 2.0, 7.0))}) AS x, {gaussian(1)} * ({wide}) + ({pick((-4.0, 6.0, -6.0))}) AS y, CAST(point_id % 3 AS INTEGER) AS part FROM {ids(n)}"
    return f"SELECT point_id, x * 0.6 + y * -0.4 AS x, x * -0.6 + y * 0.8 AS y, part FROM ({out})" if kind == "sheared" else out
