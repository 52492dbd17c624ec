"""Near-duplicate classes (10): ProbMinHash signatures, banding, exact verification.

A text's elements are its 5-word shingles (A-Z lower-cased, words apart at white space), weighted by how
often they occur; a text of one to four words is one shingle. Each element is a Poisson process
with its weight as rate whose points fall into random slots; a slot keeps the element that reaches it first,
and an element stops as soon as its clock has passed every slot's. Two texts agree in a slot with their
probability Jaccard similarity.

Texts of equal words form one class and go on as one. The least text of a band (four slots) is its hub; all texts that share
a band with a hub are its star, so two texts that share a band share a star. Stars are dealt in chunks of bounded size, each with the
star's best-connected texts. Inside a chunk every text is reached by a search that compares exactly, so links come
out as one star for each class (similarity of at least 0.8), never as all pairs. Then, in stars of several chunks, whatever isn't in the star's
main class is compared with every chunk, block by block. Classes are the components of the verified links.

Null text counts as empty; texts without words form one class. Null ids get a class like any
other row and never name one unless all ids in it are null. Rows that repeat an id are classified each by their own
text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
SIMILAR = 0.8
#: 24 bands of 4 slots: a pair at 0.8 shares none with odds of 3 in a million.
SLOTS, ROWS = 96, 4
#: Shingles and texts that a chunk holds, about; anchors that stand in every chunk of a star of several.
CHUNK, MEMBERS = 200_000, 96
ANCHORS = 8
#: Bytes of text that are sketched at a time, about: numbers made of a piece take some fifteen times its size.
PIECE = 2**20
ODDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Words of each text (large strings, so any length goes; by way of bytes, as slices of strings come out wrong)."""
    return pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_binary()), b"").cast(pa.large_string()))


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count of each text's distinct shingles, in that order."""
    lists = word_lists(texts)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = table[coded.indices.to_numpy()]
    n = np.bincount(doc, minlength=len(lists))
    ends = np.cumsum(n)
    left = ends[doc] - np.arange(len(doc))  # words from here to the text's end
    out = np.zeros(len(h), np.uint64)
    for j in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:] * np.uint64(ODDS[j % 5])
        out += _mix(np.where(left > j, part, np.uint64(0)) + np.uint64(j))
    start = (left >= width) | ((left == n[doc]) & (n[doc] < width))
    key = np.sort(doc[start].astype(np.uint64) << np.uint64(32) | (_mix(out[start]) >> np.uint64(32)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), counts


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: the element that reaches each slot first, one row a text; 2**32-1 throughout for a text without elements."""
    best = np.full(n_docs * slots, 2**64 - 1, dtype=np.uint64)  # arrival time's bits, then the element
    clock, turn = np.zeros(len(doc)), 0
    seed = _mix(element.astype(np.uint64) + np.uint64(ODDS[0]))
    while len(doc):
        step = 1 if len(doc) > 20_000 else 16
        rng = _mix(seed[:, None] + (np.arange(turn, turn + step, dtype=np.uint64) * np.uint64(ODDS[1]))[None, :])
        gap = -np.log(((rng >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[:, None]
        at = clock[:, None] + np.cumsum(gap, axis=1)
        slot = (_mix(rng + np.uint64(ODDS[2])) % np.uint64(slots)).astype(np.int64) + (doc * slots)[:, None]
        key = at.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | element.astype(np.uint64)[:, None]
        np.minimum.at(best, slot.ravel(), key.ravel())
        latest = best.reshape(n_docs, slots).max(axis=1) >> np.uint64(32)
        clock, turn = at[:, -1], turn + step
        on = clock.astype(np.float32).view(np.uint32) <= latest[doc]
        doc, element, weight, clock, seed = doc[on], element[on], weight[on], clock[on], seed[on]
    return (best & np.uint64(2**32 - 1)).astype(np.uint32).reshape(n_docs, slots)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each row."""
    parts = signature.astype(np.uint64).reshape(len(signature), -1, rows)
    h = np.arange(parts.shape[1], dtype=np.uint64)[None, :] * np.uint64(ODDS[3]) + np.zeros((len(signature), 1), np.uint64)
    for j in range(rows):
        h = _mix((h ^ parts[:, :, j]) * np.uint64(ODDS[4]) + np.uint64(j + 1))
    return h.view(np.int64)


def content_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def _sketch(batches):
    with np.errstate(over="ignore"):
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in common.slices(whole, PIECE):
                doc, element, count = shingles(b.column(1))
                at = np.searchsorted(doc, np.arange(b.num_rows + 1))
                keys = bands(signatures(doc, element, count.astype(np.float64), b.num_rows))
                raw = [element[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                many = [b"" if count[i:j].max(initial=1) == 1 else count[i:j].astype(np.uint32).tobytes() for i, j in zip(at, at[1:], strict=False)]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + b.num_rows)), b.column(0), pa.array([content_key(t) for t in b.column(1).to_pylist()], pa.binary()), pa.array(np.diff(at).astype(np.int64)), listed, pa.array(raw, pa.binary()), pa.array(many, pa.binary())],
                    ["row", "doc_id", "c", "size", "bands", "shingles", "counts"],
                )
                row += b.num_rows


# --- exact comparison -----------------------------------------------------


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (elements sorted, weights positive)."""
    i, j = np.isin(a, b, assume_unique=True), np.isin(b, a, assume_unique=True)
    x, y = wa[i].astype(float), wb[j].astype(float)
    if not len(x):
        return 0.0
    only_a, only_b = wa[~i].sum(), wb[~j].sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    below = np.searchsorted(ratio, ratio, side="left")  # elements of a lower ratio count with b's weight
    sum_x, sum_y = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(y)]
    return float(np.sum(1.0 / ((sum_x[-1] - sum_x[below] + only_a) / x + (sum_y[below] + only_b) / y)))


class _Sets:
    """Weighted sets with postings, for one-against-all comparison."""

    def __init__(self, elements: list[bytes], counts: list[bytes]):
        self.sets = [np.frombuffer(e, np.uint32) for e in elements]
        self.plain = np.array([not c for c in counts], bool)  # every weight is one
        self.counts = counts
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        if not self.plain.all():
            weights = np.concatenate([self.weights(k) for k in range(len(self.sets))])
            self.total = np.maximum(1, np.bincount(np.repeat(np.arange(len(self.sets)), self.sizes), weights, minlength=len(self.sets)))
            self.share = weights[order] / self.total[self.owner]

    def weights(self, k: int) -> np.ndarray:
        return np.ones(len(self.sets[k]), np.uint32) if self.plain[k] else np.frombuffer(self.counts[k], np.uint32)

    def near(self, k: int, open_: np.ndarray) -> list[int]:
        """The sets among ``open_`` that are similar to set k."""
        s = self.sets[k]
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        owner = self.owner[at]
        common = np.bincount(owner, minlength=len(self.sets))
        open_ = open_ & (common > 0)
        open_[k] = False
        if self.plain[k]:  # between plain sets it is the share of the common elements, in whole numbers
            plain = open_ & self.plain
            out = np.flatnonzero(plain & (5 * common >= 4 * (len(s) + self.sizes - common))).tolist()
            open_ = open_ & ~self.plain
        else:
            out = []
        if open_.any():  # the shared probability mass bounds the similarity from above; sums of fractions are rounded
            p = self.weights(k) / self.total[k]
            mass = np.bincount(owner, np.minimum(self.share[at], np.repeat(p, n)), minlength=len(self.sets))
            for j in np.flatnonzero(open_ & (mass >= SIMILAR - 1e-9)).tolist():
                if similarity(s, self.weights(k), self.sets[j], self.weights(j)) >= SIMILAR - 1e-9:
                    out.append(j)
        return out


LINKS = "a binary, b binary"
STAR = ["star", "chunk", "block", "side", "n", "c", "label", "shingles", "counts"]


def _search(rows: dict[str, list]) -> list[tuple[bytes, bytes]]:
    """The classes among a task's texts, as links from each class's first text to all others: a step compares one reached text with all that aren't."""
    order = sorted(range(len(rows["c"])), key=lambda k: (-rows["n"][k], rows["c"][k]))
    sets, names = _Sets([rows["shingles"][k] for k in order], [rows["counts"][k] for k in order]), [rows["c"][k] for k in order]
    open_, out = np.ones(len(names), bool), []
    for seed in range(len(names)):
        if not open_[seed]:
            continue
        open_[seed], queue = False, [seed]
        while queue and open_.any():
            for j in sets.near(queue.pop(), open_):
                open_[j] = False
                queue.append(j)
                out.append((names[seed], names[j]))
    return out


def _rest(rows: dict[str, list]) -> list[tuple[bytes, bytes]]:
    """Links between texts outside a star's main class (side 1) and one of its chunks (side 0): one for each pair of labels."""
    sets, label, side = _Sets(rows["shingles"], rows["counts"]), np.array(rows["label"], object), np.array(rows["side"])
    known: set[tuple[bytes, bytes]] = set()
    for k in np.flatnonzero(side == 1).tolist():
        open_ = (side == 0) & (label != label[k])
        if open_.any():
            known |= {(label[k], label[j]) for j in sets.near(k, open_)}
    return list(known)


def _each(find):
    """``find`` over the rows of each (star, chunk, block), which come together, in order, from sorted batches."""

    def run(batches):
        held: list[pa.Table] = []
        key = None

        def done():
            table = pa.concat_tables(held).to_pydict() if held else None
            return find(table) if table and len(table["c"]) > 1 else []

        for b in batches:
            keys = list(zip(*(b.column(x).to_pylist() for x in STAR[:3]), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            out: list[tuple[bytes, bytes]] = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and keys[i] != key:
                    out += done()
                    held, key = [], keys[i]
                held.append(pa.Table.from_batches([b.slice(i, j - i)]))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])
        out = done()
        yield pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    return run


def _dealt(rows: DataFrame, find) -> DataFrame:
    """Links that ``find`` sees in each (star, chunk, block) of ``rows``: as many tasks as shuffles have, each takes one such group at a time."""
    dealt = rows.select(*STAR).repartition(common.partitions(rows.sparkSession), "star", "chunk", "block").sortWithinPartitions("star", "chunk", "block")
    return dealt.mapInArrow(_each(find), LINKS).where("a <> b")


def _split(n: str, size: str) -> F.Column:
    return F.greatest(F.ceil(F.col(size) / CHUNK), F.ceil(F.col(n) / MEMBERS)).cast("int")


def labels(sketches: DataFrame) -> DataFrame:
    """``node`` (content key), ``label``: the class of every text that shares its class with another; a kept table."""
    kinds = common.keep(sketches.where("size > 0").groupBy("c").agg(F.min(F.struct("row", "size", "bands")).alias("one")).select("c", "one.*"), "near-kinds")
    found = kinds.select("c", "row", "size", F.explode("bands").alias("h"))
    hubs = found.groupBy("h").agg(F.min("c").alias("star"), F.max("c").alias("last")).where("star < last").select("h", "star")
    # the hub is in its star too, with a band for every bucket that it leads, so it comes first
    stars = common.keep(found.join(hubs, "h").groupBy("star", "c").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("size").alias("size")), "near-stars")
    sizes = stars.groupBy("star").agg(F.count("*").alias("k"), F.sum("size").alias("s"))
    sizes = common.keep(sizes.select("star", _split("k", "s").alias("chunks")).where("chunks > 1"), "near-sizes")
    place = F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int").alias("chunk")
    large = stars.join(sizes, "star").select("star", "c", "n", "row", "chunks", place)
    rank = Window.partitionBy("star").orderBy(F.desc("n"), "c")
    best = common.keep(large.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= ANCHORS).drop("rank"), "near-anchors")
    spread = best.select("star", "c", "row", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "n", F.col("chunk").alias("own"))
    spread = spread.where("chunk <> own").select("star", "c", "row", (F.col("n") + SLOTS).alias("n"), "chunk")  # before a chunk's own
    held = stars.join(sizes.select("star"), "star", "left_anti").select("star", "c", "row", "n", F.lit(0).alias("chunk"))
    held = held.unionByName(large.select("star", "c", "row", "n", "chunk")).unionByName(spread)
    payload = sketches.select("row", "shingles", "counts")
    none = F.lit(None).cast("binary").alias("label")
    first = common.keep(_dealt(held.join(payload, "row").select("star", "chunk", F.lit(0).alias("block"), F.lit(0).alias("side"), "n", "c", none, "shingles", "counts"), _search), "near-links")
    common.drop(best)
    label = components(first)
    common.drop(kinds, first)
    if not sizes.isEmpty():
        label = _joined(large, label, payload)
    common.drop(stars, sizes)
    return label


def _joined(large: DataFrame, label: DataFrame, payload: DataFrame) -> DataFrame:
    """``label`` with the links between different chunks of large stars that their best-connected texts didn't show: an exact way for the rest.

    Whatever isn't in its star's main class is compared with every chunk of the star, in blocks of a chunk's size.
    """
    named = large.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = common.keep(named.select("star", "c", "row", "chunks", "chunk", "label"), "near-large")
    main = named.groupBy("star", "label").agg(F.count("*").alias("k")).groupBy("star").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    main = common.keep(main, "near-main")
    rest = common.keep(named.join(main, "star").where("label <> main").drop("main"), "near-rest")
    if not rest.isEmpty():
        blocks = rest.groupBy("star").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        blocks = common.keep(blocks, "near-blocks")
        each = F.sequence(F.lit(0), F.col("blocks") - 1)
        here = named.join(blocks, "star").select("star", "chunk", F.explode(each).alias("block"), F.lit(0).alias("side"), "c", "label", "row")
        own = F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")).cast("int").alias("block")
        there = rest.join(blocks, "star").select("star", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), own, F.lit(1).alias("side"), "c", "label", "row")
        rows = here.union(there).join(payload, "row").withColumn("n", F.lit(0).cast("long"))
        more = common.keep(_dealt(rows, _rest), "near-links")
        if not more.isEmpty():
            joint = components(more).select(F.col("node").alias("label"), F.col("label").alias("joint"))
            # a text without a link of its own has itself as label
            alone = joint.join(label.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("joint").alias("label"))
            label = common.keep(label.join(joint, "label", "left").select("node", F.coalesce("joint", "label").alias("label")).union(alone), "near-labels")
        common.drop(more, blocks)
    common.drop(named, main, rest)
    return label


def sketch(docs: DataFrame) -> DataFrame:
    schema = "row long, doc_id long, c binary, size long, bands array<long>, shingles binary, counts binary"
    return common.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch, schema), "near-sketches", rows=1000)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id in its class), ``c`` (content key), ``n_docs`` (rows in the class); one row for each row of ``docs``."""
    sketches = sketch(docs)
    label = labels(sketches).withColumnRenamed("node", "c")
    each = sketches.groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    each = each.join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
    whole = each.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_docs"))
    return sketches.select("doc_id", "c").join(each.select("c", "label").join(whole, "label"), "c").select("doc_id", "class_id", "c", "n_docs")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their class: one row of each, all columns kept.

    Of rows that repeat both id and words one stays; a class with only null ids keeps one of its rows.
    """
    found = classes(docs)
    own = F.when(F.col("doc_id") == F.col("class_id"), F.col("c"))
    least = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(own).alias("kc")).where("kc is not null")
    least = common.keep(least.select(F.col("doc_id").alias("kd"), "kc", "n"), "near-least")
    kd = docs["doc_id"].cast("long")
    kept = docs.join(least.where("n = 1").select("kd"), kd == F.col("kd"), "left_semi")  # an id that one row has names that row
    again = least.where("n > 1").select("kd", "kc").union(found.where("doc_id is null and class_id is null").select(F.col("doc_id"), "c").distinct())
    again = common.keep(again, "near-again")
    if again.isEmpty():
        return kept
    key = common.fresh(docs, "near_key")

    @F.arrow_udf("binary")
    def content(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in (piece for whole in texts for piece in common.slices(whole, PIECE)):
            yield pa.array(map(content_key, t.to_pylist()), pa.binary())

    some = docs.join(again.select("kd").distinct(), kd.eqNullSafe(F.col("kd")), "left_semi")
    some = some.withColumn(key, content(F.col("text").cast("string")))
    some = some.join(again, some["doc_id"].cast("long").eqNullSafe(again["kd"]) & (some[key] == again["kc"]), "left_semi")
    return kept.union(some.dropDuplicates(["doc_id", key]).drop(key))
