"""Line dedup (9): sharded minimal perfect hashes over distinct line hashes.

Lines are grouped into their key hashes (64 bits and an independent fingerprint of 32), each with the number of documents
that hold it and the largest such document. Hashes go to shards; every shard
becomes one index row (a multi-level minimal perfect hash with packed fingerprint, count
and keeper arrays). Documents' own hashes probe those arrays; line texts are never
joined, and no array is broadcast: an index row goes to the tasks that hold probes of its shard, as many as
keep each at a bounded number of probes, so a line that a third of all documents hold is spread by its count.

Null or empty text is one empty line. Null ids form one document of their own
(they are told apart from every other id, and lose to any non-null id); rows that repeat an id count as one
document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bits of each level of the perfect hash for every key that is left.
GAMMA = 1.5
#: Keys of a shard, about: one index row stays near 5 MB at any corpus size.
SHARD_KEYS = 200_000
#: Probes that one task answers, about.
PROBES = 50_000
NULL_ID = -(2**63)


def line_key(line: str) -> str:
    return line.strip(WHITE).translate(UPPER)


def _hash(key: str) -> tuple[int, int]:
    """A key's hash and fingerprint, from one 128-bit hash."""
    whole = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return whole & (2**64 - 1), whole >> 96


def _hashes(text: str | None, least: int) -> set[tuple[int, int]]:
    return {_hash(key) for line in set((text or "").split("\n")) if len(line) >= least and len(key := line_key(line)) >= least}


def _pairs(least: int):
    def run(batches):
        for b in (piece for whole in batches for piece in common.slices(whole)):
            ids, hashes, prints = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _hashes(t, least)
                ids += [d] * len(found)
                hashes += [h for h, _ in found]
                prints += [f for _, f in found]
            yield pa.record_batch([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(np.array(prints, dtype=np.uint32).view(np.int32)), pa.array(ids, pa.int64())], ["h", "f", "d"])

    return run


# --- minimal perfect hash -------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Levels of bit arrays: a key rests at the first level where it meets no other key; its slot is that bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys), []
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for one that no level holds; a foreign key may get any slot."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        at, levels = 0, []
        while at < len(raw):
            n = int(np.frombuffer(raw, np.int64, 1, at)[0])
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8), count=n).astype(bool))
            at += 8 + (n + 7) // 8
        return cls(levels)


def _joint(h: np.ndarray, f: np.ndarray, seed: int) -> np.ndarray:
    """The key that the perfect hash sees, of hash and fingerprint."""
    with np.errstate(over="ignore"):
        return _mix(h ^ _mix(f.astype(np.uint64), seed), seed)


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    h, f, seed = pdf["h"].to_numpy().view(np.uint64), pdf["f"].to_numpy().view(np.uint32), 0
    while len(np.unique(keys := _joint(h, f, seed))) < len(h):  # so that no two lines of a shard share a key
        seed += 1
    index = PerfectHash.build(keys)
    slot = index.slots(keys)
    prints, counts, keeper = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[slot], counts[slot], keeper[slot] = f, np.minimum(pdf["n"].to_numpy(), 2**32 - 1), pdf["keeper"].to_numpy()
    return pd.DataFrame({"shard": [key[0]], "seed": [seed], "mph": [index.dump()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "keepers": [keeper.tobytes()]})


INDEX = "shard int, seed int, mph binary, prints binary, counts binary, keepers binary"


def _probe(min_docs: int):
    def run(key: tuple, probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(index):
            return pd.DataFrame({"d": pd.Series(dtype="int64"), "h": pd.Series(dtype="int64"), "f": pd.Series(dtype="int32")})
        row = index.iloc[0]
        prints, counts, keepers = (np.frombuffer(row[c], t) for c, t in (("prints", np.uint32), ("counts", np.uint32), ("keepers", np.int64)))
        h, f, d = probes["h"].to_numpy().view(np.uint64), probes["f"].to_numpy().view(np.uint32), probes["d"].to_numpy()
        slot = PerfectHash.load(row["mph"]).slots(_joint(h, f, int(row["seed"])))
        ok = slot >= 0
        ok[ok] = prints[slot[ok]] == f[ok]
        ok[ok] = (counts[slot[ok]] >= min_docs) & (keepers[slot[ok]] != d[ok])
        return pd.DataFrame({"d": d[ok], "h": h[ok].view(np.int64), "f": f[ok].view(np.int32)})

    return run


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``d`` (null ids as the least long), ``drop``: hash and fingerprint of the lines that document d loses."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), "text").mapInArrow(_pairs(min_chars), "h long, f int, d long")
    pairs = common.keep(found.distinct(), "line-pairs")
    shards = max(1, -(-pairs.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")
    lines = pairs.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("d").alias("keeper"))
    # a shard has as many probe tasks as its probes need; most have the share of the whole that makes one
    splits = pairs.groupBy(shard).agg(F.ceil(F.count("*") / PROBES).cast("int").alias("splits"))
    splits = common.keep(splits, "line-splits")
    index = common.keep(lines.select("h", "f", "n", "keeper", shard).groupBy("shard").applyInPandas(_build, INDEX), "line-index")
    index = index.join(splits, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    probes = pairs.select("h", "f", "d", shard).join(splits, "shard").withColumn("part", F.pmod(F.xxhash64("d"), F.col("splits")).cast("int")).drop("splits")
    hits = probes.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInPandas(_probe(min_docs), "d long, h long, f int")
    return hits.groupBy("d").agg(F.collect_list(F.struct("h", "f")).alias("drop"))


def _cut(text: str | None, drop, least: int) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if drop is None or not len(drop):
        return lines, 0
    gone = {(x["h"] & (2**64 - 1), x["f"] & (2**32 - 1)) for x in drop}
    kept = [x for x in lines if len(x) < least or len(k := line_key(x)) < least or _hash(k) not in gone]
    return kept, len(lines) - len(kept)


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines; with ``counts`` also ``n_lines`` (before), ``n_dropped``.

    With ``counts``, columns of those two names that ``docs`` already has are replaced; ``text`` comes out null only
    where it came in null. All other columns stay as they are.
    """
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    d, drop = common.fresh(docs, "line_d"), common.fresh(docs, "line_drop")
    gone = repeated_lines(docs, min_chars, min_docs).select(F.col("d").alias(d), F.col("drop").alias(drop))
    joined = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(gone, d, "left")

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cut(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # a task's rows may be one batch
        for texts, drops in batches:
            rows = pa.record_batch([texts, drops], ["text", "drop"])
            for b in common.slices(rows):
                out = [(t, *_cut(t, g, min_chars)) for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                text = pa.array([None if t is None else "\n".join(k) for t, k, _ in out], pa.string())
                yield pa.StructArray.from_arrays([text, pa.array([len(k) + n for _, k, n in out], pa.int64()), pa.array([n for _, _, n in out], pa.int64())], ["text", "n_lines", "n_dropped"])

    r = common.fresh(joined, "line_r")
    out = joined.withColumn(r, cut("text", F.col(drop)))
    return out.select(*[F.col(f"{r}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[f"{r}.{c}" for c in ("n_lines", "n_dropped") if counts])
