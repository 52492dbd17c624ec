"""Exact neighbour joins.

A distance predicate alone plans as a nested loop over all pairs. These joins put points into grid cells and join on cells;
the distance is a filter on top. Cells and ranges of cells come from the same monotone arithmetic, so rounding can't part a pair.
Tables with a ``cloud_id`` (or the columns given as ``by``) are joined cloud by cloud.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from . import cloud, graph
from .session import clouds, cut

AXES = ("x", "y", "z")


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"c{c}") for c in AXES]


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row once for its own and each of the 26 neighbouring cells."""
    shifts = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, ("i", "j", "k"), strict=True)]) for s in itertools.product((-1, 0, 1), repeat=3)])
    out = df.withColumn("_s", F.explode(shifts))
    return out.select(*df.columns, *[(F.floor(F.col(c) / size) + F.col(f"_s.{n}")).alias(f"c{c}") for c, n in zip(AXES, ("i", "j", "k"), strict=True)])


def radius_join(queries: DataFrame, points: DataFrame, r: float, exclude_self: bool = False, by: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """query_id, neighbor_id, dist for every pair at most r apart (r included).

    ``by`` holds clouds apart; columns in ``carry`` come along from the sides that have them, as q_<name> and n_<name>.
    """
    by = clouds(points, by)
    size = r * (1 + 1e-9) if r > 0 else 1.0
    ours, theirs = ([c for c in carry if c not in by and c in side.columns] for side in (queries, points))
    q = _around(queries.select(*by, F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in dict.fromkeys((*AXES, *ours))], *AXES), size).drop(*AXES)
    p = points.select(*by, F.col("point_id").alias("neighbor_id"), *[F.col(c).alias(f"n_{c}") for c in dict.fromkeys((*AXES, *theirs))], *_cells(size))
    pairs = q.join(p, [*by, "cx", "cy", "cz"]).withColumn("dist", _gap())
    pairs = pairs.where(F.col("dist") <= r)
    if exclude_self:
        pairs = pairs.where("query_id <> neighbor_id")
    return pairs.select(*by, "query_id", "neighbor_id", "dist", *[f"q_{c}" for c in ours], *[f"n_{c}" for c in theirs])


def _gap() -> Column:
    return g.dist(g.triple(*[f"n_{c}" for c in AXES]), g.triple(*[f"q_{c}" for c in AXES]))


def radius_count(points: DataFrame, r: float, by: Sequence[str] | None = None) -> DataFrame:
    """Neighbours of every point, itself included."""
    by = clouds(points, by)
    return radius_join(points, points, r, by=by).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.count("*").alias("n"))


def _ranked(pairs: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by, "query_id").orderBy("dist", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(df: DataFrame, by: Sequence[str], size: int, names: dict[str, str]) -> DataFrame:
    """Rows with an array for each of id, x, y, z (as ``names`` has them): points of a cloud, about ``size`` of them. Points without a place have no distance and are left out."""
    placed = df.select(*by, "point_id", *[F.col(c).cast("double").alias(c) for c in AXES])
    placed = placed.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in AXES]))
    parts = cut(placed.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_parts")))
    dealt = cloud.same_cloud(placed, parts, by).withColumn("_part", F.pmod(F.xxhash64("point_id"), F.greatest("_parts", F.lit(1))))
    rows = dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct("point_id", *AXES)).alias("_rows"))
    return rows.select(*by, *[F.col(f"_rows.{c}").alias(n) for c, n in names.items()])


def _nearest_of_block(k: int, exclude_self: bool, chunk: int = 16):
    """The k nearest points of a block to each query of another, by (dist, id): what may be among them by a bound from the first points, then exactly."""

    def run(q_ids, q, ids, p):
        want = min(len(ids), k + 1 if exclude_self else k)
        some = min(len(ids), max(1024, want))
        for a in range(0, len(q_ids), chunk):
            at = slice(a, a + chunk)
            d2 = None
            for x, y in zip(q, p, strict=True):  # in the order of ``g.dist2``
                gap = y[None, :] - x[at, None]
                gap *= gap
                d2 = gap if d2 is None else np.add(d2, gap, out=d2)
            edge = np.partition(d2[:, :some], want - 1, axis=1)[:, want - 1] * (1 + 1e-14)  # roots of different squares may be equal
            i, j = np.nonzero(d2 <= edge[:, None])
            d = np.sqrt(d2[i, j])
            if exclude_self:
                other = q_ids[a + i] != ids[j]
                i, j, d = i[other], j[other], d[other]
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield q_ids[a + i[ok]], ids[j[ok]], d[ok]

    return run


def knn_brute(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, by: Sequence[str] | None = None, blocks: tuple[int, int] = (4096, 32768)) -> DataFrame:
    """Every query against every point of its cloud: the definition, in blocks of queries and of points. Of a pair of blocks only k rows a query are written."""
    by = clouds(points, by)
    q = _blocks(queries, by, blocks[0], {"point_id": "_q", "x": "_qx", "y": "_qy", "z": "_qz"})
    p = _blocks(points, by, blocks[1], {"point_id": "_p", "x": "_px", "y": "_py", "z": "_pz"})
    pairs = (q.join(p, by) if by else q.crossJoin(p)).repartition(F.rand(1))
    nearest, width = _nearest_of_block(k, exclude_self), len(by)

    def near(batches):
        for b in batches:
            for row in range(b.num_rows):
                q_ids, *q, ids, x, y, z = (b.column(width + c)[row].values.to_numpy(zero_copy_only=False) for c in range(8))
                found = [np.concatenate(c) for c in zip(*nearest(q_ids, q, ids, (x, y, z)), strict=True)]
                same = [pa.array([b.column(c)[row].as_py()] * len(found[0]), b.schema.field(c).type) for c in range(width)]
                yield pa.record_batch([*same, *map(pa.array, found)], [*by, "query_id", "neighbor_id", "dist"])

    schema = T.StructType([*[points.schema[c] for c in by], T.StructField("query_id", queries.schema["point_id"].dataType), T.StructField("neighbor_id", points.schema["point_id"].dataType), T.StructField("dist", T.DoubleType())])
    return _ranked(pairs.mapInArrow(near, schema), k, by).select(*by, "query_id", "neighbor_id", "dist", "rank")


def knn_join(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, by: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """query_id, neighbor_id, dist, rank: the k nearest by (dist, id); fewer if there are fewer points. ``carry``: the neighbours' columns, as n_<name>.

    Cells of an octree are counted from its deepest level upwards. A query's smallest cell that holds k points bounds its k-th
    distance; cells no smaller than that distance, a few around the query, then hold all candidates. So dense and empty regions each
    work at their own level, and there are no rounds. Of points in one place the least ids stand for all.
    """
    by = clouds(points, by)
    want = k + 1 if exclude_self else k
    box = points.groupBy(*by).agg(*[F.min(c).alias(f"l{c}") for c in AXES], F.greatest(*[F.max(c) - F.min(c) for c in AXES]).alias("side"), F.count("*").alias("n"))
    box = box.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))
    if by:
        box = cut(box)
        most = box.agg(F.max("n")).first()[0] or 0
        boxed = lambda df: cloud.same_cloud(df, box, by)
    else:
        row = box.first()
        most = row["n"]
        boxed = lambda df: df.withColumns({c: F.lit(row[c]).cast("double") for c in ("lx", "ly", "lz", "side")})
    deep = min(30, max(0, math.ceil(math.log2(max(1, most / want)) / 3)) + 8)
    levels = F.sequence(F.lit(0), F.lit(deep))
    cell = ["ci", "cj", "ck"]

    def index(value: Column, axis: str) -> Column:
        """Of the deepest cell; what lies outside the box counts at its edge."""
        return F.least(F.greatest(F.floor((value - F.col(f"l{axis}")) / F.col("side") * 2.0**deep), F.lit(0)), F.lit(2**deep - 1)).cast("long")

    def up(c: str, level: Column) -> Column:
        return F.call_function("shiftright", F.col(c), (F.lit(deep) - level).cast("int")).alias(c)

    place = Window.partitionBy(*by, *AXES).orderBy("point_id")
    kept = list(dict.fromkeys((*AXES, *(c for c in carry if c not in by))))
    p = points.withColumn("_same", F.row_number().over(place)).where(F.col("_same") <= want)
    p = boxed(p).select(*by, F.col("point_id").alias("neighbor_id"), *[F.col(c).alias(f"n_{c}") for c in kept], *[index(F.col(c), c).alias(i) for c, i in zip(AXES, cell, strict=True)])
    q = boxed(queries).select(*by, F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in AXES], *[f"l{c}" for c in AXES], "side", *[index(F.col(c), c).alias(i) for c, i in zip(AXES, cell, strict=True)])

    def leveled(df: DataFrame, at: Column) -> DataFrame:
        out = df.withColumn("level", F.explode(at))
        return out.withColumns({c: up(c, F.col("level")) for c in cell})

    occupied = p.groupBy(*by, *cell).agg(F.count("*").alias("m"))
    full = leveled(occupied, levels).groupBy(*by, "level", *cell).agg(F.sum("m").alias("m")).where(F.col("m") >= want)
    spots = q.select(*by, *cell).distinct().select(*by, *[F.col(c).alias(f"d{c}") for c in cell], *cell)
    depth = leveled(spots, levels).join(full, [*by, "level", *cell]).groupBy(*by, *[f"d{c}" for c in cell]).agg(F.max("level").alias("level"))
    depth = cut(depth.withColumnsRenamed({f"d{c}": c for c in cell}))
    used = [r["level"] for r in depth.select("level").distinct().collect()]  # at most 31 numbers
    here = q.join(depth, [*by, *cell]).withColumns({c: up(c, F.col("level")) for c in cell})
    reach = q.drop(*cell)
    if used:
        pairs = here.join(leveled(p.select(*by, "neighbor_id", *[f"n_{c}" for c in AXES], *cell), F.array(*map(F.lit, used))), [*by, "level", *cell])
        kth = pairs.groupBy(*by, "query_id").agg(F.sort_array(F.collect_list(_gap()))[want - 1].alias("r"))
        reach = reach.join(kth, [*by, "query_id"], "left")
    else:
        reach = reach.withColumn("r", F.lit(None).cast("double"))
    reach = reach.withColumn("r", F.col("r") * (1 + 1e-9))
    level = F.when(F.col("r") > 0, F.least(F.greatest(F.floor(F.log2(F.col("side") / F.col("r"))), F.lit(0)), F.lit(deep))).when(F.col("r") == 0, deep).otherwise(0).cast("int")
    reach = cut(reach.withColumn("level", level))
    used = [r["level"] for r in reach.select("level").distinct().collect()]
    if not used:
        return _ranked(reach.select(*by, "query_id", F.lit(0).cast("long").alias("neighbor_id"), F.lit(0.0).alias("dist"), *[F.lit(None).alias(f"n_{c}") for c in carry]), k, by)
    near = reach
    for axis, c in zip(AXES, cell, strict=True):
        ends = [index(F.col(f"q_{axis}") + s * F.coalesce("r", F.lit(float("inf"))), axis) for s in (-1, 1)]
        lo, hi = (F.call_function("shiftright", e, (F.lit(deep) - F.col("level")).cast("int")) for e in ends)
        near = near.withColumn(c, F.explode(F.sequence(lo, hi)))
    found = near.join(leveled(p, F.array(*map(F.lit, used))), [*by, "level", *cell]).withColumn("dist", _gap())
    found = found.where(F.col("r").isNull() | (F.col("dist") <= F.col("r")))
    if exclude_self:
        found = found.where("query_id <> neighbor_id")
    return _ranked(found.select(*by, "query_id", "neighbor_id", "dist", *[f"n_{c}" for c in carry]), k, by)


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("point_id", kind="stable")
    x = np.stack(pdf["features"]).astype(np.float64)
    return pd.DataFrame({"part": [key[0]], "ids": [pdf["point_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"], np.float64).reshape(len(ids), -1)


def knn_vectors(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, block: int = 1024) -> DataFrame:
    """Nearest vectors (point_id, features) in any dimension, exactly, block against block.

    Both sides are packed into blocks of bounded size, one row each. A pair of blocks is one matrix product, which leaves out what can't be among the
    k nearest by more than its rounding; distances of the rest are taken directly, and only k rows a query leave the pair.
    """

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        part = F.pmod(F.xxhash64("point_id"), F.lit(n)).cast("int").alias("part")
        rows = df.select("point_id", F.col("features").cast("array<double>").alias("features"), part)
        return rows.groupBy("part").applyInPandas(_pack, "part int, ids binary, x binary"), n

    def near(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                (q_ids, x), (ids, y) = _open({"ids": r["q_ids"], "x": r["q_x"]}), _open(r)
                xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
                slack = 1e-12 * (x.shape[1] + 8) * (xx.max() + yy.max())  # a product's rounding is below this
                want = min(len(ids), k + 1 if exclude_self else k)
                out = []
                for a in range(0, len(x), 512):
                    d2 = xx[a : a + 512, None] + yy[None, :] - 2.0 * (x[a : a + 512] @ y.T)
                    edge = np.partition(d2, want - 1, axis=1)[:, want - 1] + 2 * slack
                    i, j = np.nonzero(d2 <= edge[:, None])
                    if exclude_self:
                        other = q_ids[a + i] != ids[j]
                        i, j = i[other], j[other]
                    d = np.sqrt(((y[j] - x[a + i]) ** 2).sum(axis=1))
                    order = np.lexsort((ids[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    first = np.searchsorted(i, i)  # place of each query's first row
                    ok = np.arange(len(i)) - first < k
                    out.append(pd.DataFrame({"query_id": q_ids[a + i[ok]], "neighbor_id": ids[j[ok]], "dist": d[ok]}))
                yield pd.concat(out)

    (q, _), (p, n_p) = packed(queries), packed(points)
    turns = F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)))
    pairs = q.select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), turns.alias("part"))
    found = pairs.join(p, "part").repartition(F.rand(1)).mapInPandas(near, "query_id long, neighbor_id long, dist double")
    return _ranked(found, k, ()).select("query_id", "neighbor_id", "dist", "rank")


def pairwise(points: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Squared distances of all ordered pairs of a cloud: quadratic by definition, so for small tables."""
    by = clouds(points, by)
    a = points.select(*by, F.col("point_id").alias("src"), *[F.col(c).alias(f"a{c}") for c in AXES])
    b = points.select(*[F.col(c).alias(f"b_{c}") for c in by], F.col("point_id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in AXES])
    on = [F.col(c) == F.col(f"b_{c}") for c in by]
    half = a.join(b, [*on, F.col("src") < F.col("dst")]).select(*by, "src", "dst", g.dist2(g.triple("ax", "ay", "az"), g.triple("bx", "by", "bz")).alias("d2"))
    same = points.select(*by, F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(0.0).alias("d2"))
    return half.union(half.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).union(same)


def knn_graph(points: DataFrame, k: int, sigma: float = 1.0, by: Sequence[str] | None = None) -> DataFrame:
    """Edges src, dst, w = exp(-d^2 / 2 sigma^2) between points of which one is among the other's k nearest."""
    by = clouds(points, by)
    near = knn_join(points, points, k, exclude_self=True, by=by).select(*by, F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), (F.col("dist") * F.col("dist")).alias("d2"))
    return graph.symmetric(near).select(*by, "src", "dst", F.exp(-F.col("d2") / (2.0 * sigma * sigma)).alias("w"))
