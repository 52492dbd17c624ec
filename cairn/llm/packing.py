"""Best-fit packing (1): hierarchical residual packing.

Every task packs its own pieces by best fit, longest first. Bins that are nearly full are
final. The others become items of the next round: they are dealt to fewer tasks and packed
again, as wholes, until one task has packed all that were left or a round closes less than a hundredth of them. Only bins move
between rounds, as (bin, length) rows; a round has as many tasks as keep each at a bounded
number of bins, so no task gathers a whole corpus.

Null text counts as empty: its ids are the closing id alone. Null ids and rows that repeat an id
are packed as documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, word_tokens

SIZE = 2048
#: A bin with at most this much room is final.
ROOM = 8
#: Items that a task holds at once, in the first round and later.
TASK_ITEMS = 100_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, fill of each bin: longest item first, into the fullest bin that takes it."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r is set if a bin has room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        above = some >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, np.array(fills, dtype=np.int64)


def _first_id() -> int:
    return TaskContext.get().partitionId() << 36


def _cut_and_pack(path: str, size: int):
    def pack(rows: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        cols = list(zip(*rows, strict=True))
        lengths = np.array(cols[3], dtype=np.int64)
        bins, at, fills = best_fit(lengths, size)
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(lengths), pa.array(cols[4], pa.int64()), pa.array(bins + first), pa.array(at), pa.array(fills[bins])]
        return pa.record_batch(arrays, [x.split()[0] for x in SCHEMA.split(", ")]), first + len(fills)

    def run(batches):
        encode, first, rows = word_tokens.load(path).encode, _first_id(), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or b"") + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= TASK_ITEMS:
                out, first = pack(rows, first)
                rows = []
                yield out
        if rows:
            yield pack(rows, first)[0]

    return run


def _repack(size: int, level: int):
    def run(batches):
        first, held = _first_id() + (level << 56), []

        def pack(held):
            ids, fills = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            order = np.lexsort((ids, -fills))  # the same result whatever order the rows came in
            ids, fills = ids[order], fills[order]
            bins, at, full = best_fit(fills, size)
            return pa.record_batch([pa.array(ids), pa.array(bins + first), pa.array(at), pa.array(full[bins])], ["bin", "up", "at", "fill"]), first + len(full)

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 4 * TASK_ITEMS:
                out, first = pack(held)
                held = []
                yield out
        if sum(map(len, held)):
            yield pack(held)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts longer than ``size`` ids (with the closing 0) are cut; nothing is dropped or padded.
    """
    items = common.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_cut_and_pack(tokenizer, size), SCHEMA), "pack-items")
    open_ = F.col("fill") < size - ROOM
    todo = items.where((F.col("at") == 0) & open_).select("bin", "fill")
    moved, left, level = [], todo.count(), 0
    while left > 1:
        level += 1
        tasks = -(-left // TASK_ITEMS)
        step = common.keep(todo.repartition(tasks, F.xxhash64("bin", F.lit(level))).mapInArrow(_repack(size, level), "bin long, up long, at long, fill long"), "pack-bins")
        moved.append(step)
        todo = step.where((F.col("at") == 0) & open_).select(F.col("up").alias("bin"), "fill")
        now = todo.count()
        if tasks == 1 or now > 0.99 * left:
            break
        left = now
    where = None
    for step in reversed(moved):  # where each level's bins end up
        step = step.select("bin", "up", F.col("at").alias("shift"))
        if where is None:
            where = step
        else:
            above = where.select(F.col("bin").alias("up"), F.col("up").alias("top"), F.col("shift").alias("more"))
            where = step.join(above, "up", "left").select("bin", F.coalesce("top", "up").alias("up"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    out = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    if where is None:
        return items.select(*out, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return items.join(where, "bin", "left").select(*out, F.coalesce("up", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
