"""Exact top-k inner product (4): a ball tree for each shard, searched by branch and bound.

Vectors become integers, floor(256 * x), and go to shards of bounded size by a hash of their id; a shard becomes one
ball tree. Queries go in blocks. A block visits the shards in waves of one, then two, four and so on; after each wave its queries' best are
merged, so every wave starts from the k-th scores of all before it, and inside a shard the bound rises as leaves are read. A
query reads leaves by falling upper bound (query . centre + |query| * radius) and stops at the first one below
its k-th score; equal bounds are read, since ties go to smaller ids.

Vectors that are null or hold a null or non-finite component (256 times it included) take no part, nor do rows without
an id; empty vectors score 0. Vectors of unequal length multiply over the components both have. Integers of any size are
multiplied exactly; scores beyond the range of a long count as its nearest end. Rows that repeat an id are candidates each and,
where they are queries, queries each: every one has its own ranks, and only the row itself isn't its candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
SHARD, LEAF, BLOCK = 8192, 64, 256
#: Query blocks that one task searches a shard with, at most.
TOGETHER = 32
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Balls:
    """A ball tree in arrays over points of whole-numbered doubles; ``rows`` names them, ``ids`` breaks ties."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        points = points.astype(np.float64)
        self.most = float(np.abs(points).max(initial=0))
        order, self.nodes = np.arange(len(points)), []  # (centre, its length, radius, lo, hi, parent, is a leaf)
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, up = todo.pop()
            p = points[order[lo:hi]]
            centre = p.mean(axis=0)
            far = ((p - centre) ** 2).sum(axis=1)
            leaf = hi - lo <= LEAF or far.max() == 0 or self.most > 1e120
            self.nodes.append((centre, np.sqrt((centre * centre).sum()), np.sqrt(far.max()), lo, hi, up, leaf))
            if not leaf:
                a = p[far.argmax()]
                b = p[((p - a) ** 2).sum(axis=1).argmax()]
                side = np.argsort(p @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][side]
                mid, me = (lo + hi) // 2, len(self.nodes) - 1
                todo += [(lo, mid, me), (mid, hi, me)]
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    def scores(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        p = self.points[lo:hi]
        largest = self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        if largest < 2**53:
            return (q @ p.T).astype(np.int64)
        if largest < 2**62 and self.most < 2**62 and np.abs(q).max() < 2**62:
            return q.astype(np.int64) @ p.T.astype(np.int64)
        whole = [[int(x) for x in row] for row in p.tolist()]  # doubles are exact; so are Python's integers
        each = [[sum(int(x) * y for x, y in zip(a, b, strict=True) if x) for b in whole] for a in q.tolist()]
        return np.array([[min(max(x, LOW + 1), HIGH) for x in row] for row in each], np.int64)

    def search(self, ids: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best k (unfilled: the least long, -1), none of them below ``least``; ``own`` names the queries' rows."""
        wide = max(q.shape[1], self.points.shape[1])
        if q.shape[1] < wide:
            q = np.pad(q, ((0, 0), (0, wide - q.shape[1])))
        elif self.points.shape[1] < wide:
            self.points = np.pad(self.points, ((0, 0), (0, wide - self.points.shape[1])))
            self.nodes = [(np.pad(c, (0, wide - len(c))), *rest) for c, *rest in self.nodes]
        best, who = np.full((len(q), k), LOW), np.full((len(q), k), -1)
        bound = np.empty((len(self.nodes), len(q)))
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((q * q).sum(axis=1))
            for m, (centre, far, radius, _, _, up, _) in enumerate(self.nodes):  # a child's bound is no higher than its parent's
                bound[m] = q @ centre + length * (radius * (1 + 1e-9) + far * 1e-9) + 1e-3
                bound[m][~np.isfinite(bound[m])] = np.inf
                if up >= 0:
                    np.minimum(bound[m], bound[up], out=bound[m])
        leaves = np.array([m for m, x in enumerate(self.nodes) if x[-1]])
        rank = np.argsort(-bound[leaves], axis=0, kind="stable")
        on = np.arange(len(q))
        for step in range(len(leaves)):
            leaf = leaves[rank[step, on]]
            ok = bound[leaf, on] >= np.maximum(best[on, -1], least[on]).astype(np.float64)
            on, leaf = on[ok], leaf[ok]
            if not len(on):
                break
            turn = np.argsort(leaf, kind="stable")
            for group in np.split(turn, np.flatnonzero(np.diff(leaf[turn])) + 1):
                _, _, _, lo, hi, _, _ = self.nodes[leaf[group[0]]]
                rows = on[group]
                s = self.scores(q[rows], lo, hi)
                fit = (s >= np.maximum(best[rows, -1], least[rows])[:, None]) & (self.rows[None, lo:hi] != own[rows, None])
                for r, mask, values in zip(rows[fit.any(axis=1)], fit[fit.any(axis=1)], s[fit.any(axis=1)], strict=True):
                    best[r], who[r] = _best(np.r_[best[r], values[mask]], np.r_[who[r], self.ids[lo:hi][mask]], k)
        return best, who


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -np.maximum(scores, LOW + 1), scores == LOW))[:k]
    return scores[top], ids[top]


def integers(points: DataFrame) -> DataFrame:
    """``vec_id`` and the vector ``x`` (doubles) of every row that takes part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda y: F.coalesce(F.abs(y * SCALE) < float("inf"), F.lit(False)))
    return points.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(fine)


PACKED = "part int, ids binary, own binary, wide int, whole boolean, vectors binary"


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
    out = np.zeros((len(pdf), max(map(len, pdf["x"]))))
    for k, v in enumerate(pdf["x"]):
        out[k, : len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
    whole = bool(np.abs(out).max(initial=0) < 2**31)  # then half the room does
    return pd.DataFrame({"part": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "own": [pdf["row"].to_numpy(np.int64).tobytes()], "wide": [out.shape[1]], "whole": [whole], "vectors": [(out.astype(np.int32) if whole else out).tobytes()]})


def _packed(df: DataFrame, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64("vec_id", "row"), F.lit(parts)).cast("int").alias("part")
    return df.select("vec_id", "row", "x", part).groupBy("part").applyInPandas(_pack, PACKED)


def _open(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64)
    return ids, own, np.frombuffer(row["vectors"], np.int32 if row["whole"] else np.float64).reshape(len(ids), row["wide"])


FOUND = "part int, scores binary, who binary"


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "scores", "who"]).astype({"part": "int32"})


def _search(k: int):
    def run(key: tuple, blocks: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(shards):
            ids, own, points = _open(shards.iloc[0])
            tree = Balls(points, ids, own)
            for _, row in blocks.sort_values("part").iterrows():
                q_ids, q_own, q = _open(row)
                least = np.frombuffer(row["scores"], np.int64).reshape(len(q), k)[:, -1]
                best, who = tree.search(q_ids, q_own, q.astype(np.float64), k, least)
                out.append((row["part"], best.tobytes(), who.tobytes()))
        return _found(out)

    return run


def _nothing(k: int):
    def run(batches):
        for pdf in batches:
            n = [k * len(x) // 8 for x in pdf["ids"]]
            yield _found([(p, np.full(m, LOW).tobytes(), np.full(m, -1).tobytes()) for p, m in zip(pdf["part"], n, strict=True)])

    return run


def _merge(k: int):
    """A block's best so far."""

    def run(key: tuple, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        each = [*state.to_dict("records"), *found.to_dict("records")]
        scores = np.concatenate([np.frombuffer(r["scores"], np.int64).reshape(-1, k) for r in each], axis=1)
        who = np.concatenate([np.frombuffer(r["who"], np.int64).reshape(-1, k) for r in each], axis=1)
        best = [_best(a, b, k) for a, b in zip(scores, who, strict=True)]
        return _found([(key[0], np.array([a for a, _ in best]).tobytes(), np.array([b for _, b in best]).tobytes())])

    return run


def _ranked(k: int):
    def run(batches):
        for pdf in batches:
            for ids, scores, who in zip(pdf["ids"], pdf["scores"], pdf["who"], strict=True):
                ids, scores, who = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.int64).reshape(-1, k), np.frombuffer(who, np.int64).reshape(-1, k)
                q, at = np.nonzero(scores > LOW)
                yield pd.DataFrame({"query_id": ids[q], "rank": (at + 1).astype(np.int32), "vec_id": who[q, at], "score": scores[q, at]})

    return run


def top_k(points: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    vectors = common.keep(integers(points).withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    asked = vectors.where(F.col("vec_id") % every == 0)
    n_shards, n_blocks = max(1, -(-vectors.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    shards = common.keep(_packed(vectors, n_shards).withColumnRenamed("part", "shard"), "search-shards")
    blocks = common.keep(_packed(asked, n_blocks), "search-blocks")
    common.drop(vectors)
    state, last = blocks.select("part", "ids").mapInPandas(_nothing(k), FOUND), None
    offset, width = 0, 1
    while offset < n_shards:
        width = min(width, n_shards - offset)
        turns = F.explode(F.sequence(F.lit(offset), F.lit(offset + width - 1)))
        pairs = blocks.join(state, "part").withColumn("shard", turns).withColumn("shard", F.pmod(F.col("part") + F.col("shard"), F.lit(n_shards)).cast("int"))
        pairs = pairs.withColumn("team", (F.col("part") / TOGETHER).cast("int"))
        spread = shards.join(blocks.select((F.col("part") / TOGETHER).cast("int").alias("team"), turns.alias("turn"), "part").select("team", F.pmod(F.col("part") + F.col("turn"), F.lit(n_shards)).cast("int").alias("shard")).distinct(), "shard")
        found = pairs.groupBy("shard", "team").cogroup(spread.groupBy("shard", "team")).applyInPandas(_search(k), FOUND)
        state = common.keep(state.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(_merge(k), FOUND), "search-best")
        if last is not None:
            common.drop(last)
        last = state
        offset, width = offset + width, 2 * width
    return blocks.select("part", "ids").join(state, "part").mapInPandas(_ranked(k), "query_id long, rank int, vec_id long, score long")
