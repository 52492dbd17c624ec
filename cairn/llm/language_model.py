"""LM scoring (5): a nested hierarchical Pitman-Yor model of word pairs.

A word's probability after the word before it (the end token before a text's first word) comes from the restaurant of that
context; all contexts share a restaurant over words as parent, whose base measure spells words byte by byte:
restaurants of two-byte contexts share the one-byte contexts as parents, those share the empty context, and
that one a uniform distribution. Seating is sampled by Gibbs sweeps: given the parent, each dish's customers
are seated one after the other (in blocks once many sit). A table of a context sends its word as a customer to the word restaurant;
a table there is one spelling, which sends its bytes as customers to the byte contexts, which are seated in turn. The
predictive probabilities of all kept sweeps are averaged. Words outside the training vocabulary are one event, as in the base score: it gets
what the spellings of all known words leave.

Nothing is sized by the vocabulary but what is dealt out. Documents are read in batches; a batch's distinct words go
to shards by hash, shards merge them and number them (below 2**32). A batch's distinct pairs go to the shard of their context's
number; pairs of a hot context are dealt by their word, and only the table totals of hot contexts (at most four a shard) are
summed centrally. Pairs seen once have one table, so sweeps exchange words of other pairs only. Each shard answers a batch in
the order asked. Only byte-context counts (at most 257 * 257 * 257 cells, so bounded), totals and hot contexts reach the driver.

Null text counts as empty (its only token is the end). Null ids are never held out. Rows that repeat an id are scored one by one.
An empty table gives an empty result; without training documents every word counts 0.
"""

from __future__ import annotations

import functools
import math
import zlib
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dedup import word_lists

#: Text bytes of one batch, about.
BATCH = 12_000_000
DISCOUNT, STRENGTH = 0.6, 1.0
SPELL_DISCOUNT, SPELL_STRENGTH = 0.5, 2.0
PAIR_DISCOUNT, PAIR_STRENGTH = 0.75, 1.0
SWEEPS, BURN_IN = 4, 1
#: Customers seated one by one before blocks begin, and a block's size against those already seated.
ONE_BY_ONE, BLOCK = 24, 0.05
#: Contexts counted as hot: at most so many for each shard, and of more customers than that.
HOT_EACH, HOT_LEAST = 4, 1000
STOP = 256  # the byte after a word's last one
END = b""  # the token that ends a text; no word is empty


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


# --- seating --------------------------------------------------------------


def seat(customers: np.ndarray, parent: np.ndarray, total_tables: np.ndarray | float, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that each dish gets when its customers sit down, given the parent's probability of the dish.

    The next customer opens a table with odds (strength + discount * all tables) * parent : seated - discount * tables.
    """
    tables = (customers > 0).astype(np.int64)
    new = (strength + discount * np.broadcast_to(total_tables, customers.shape)) * parent
    seated = tables.astype(np.float64)
    on = np.flatnonzero(customers > 1)
    while len(on):
        block = np.where(seated[on] < ONE_BY_ONE, 1, np.maximum(1, (seated[on] * BLOCK).astype(np.int64)))
        block = np.minimum(block, customers[on] - seated[on]).astype(np.int64)
        odds = new[on] / (new[on] + seated[on] - discount * tables[on])
        tables[on] += rng.binomial(block, odds)
        seated[on] += block
        on = on[seated[on] < customers[on]]
    return tables


def predictive(customers, tables, all_customers, all_tables, parent, discount, strength):
    return (np.maximum(customers - discount * tables, 0) + (strength + discount * all_tables) * parent) / (strength + all_customers)


class Speller:
    """Byte contexts of two, one and no bytes; ``cells``: context pair * 257 + byte, ``n``: customers."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, rng: np.random.Generator):
        self.cells, d, s = cells, SPELL_DISCOUNT, SPELL_STRENGTH
        mid = np.unique(cells % 257**2)  # last context byte and next byte
        up2, up1 = np.searchsorted(mid, cells % 257**2), mid % 257
        p0 = np.full(257, 1 / 257)
        t2 = (n > 0).astype(np.int64)
        for _ in range(2):  # down the tree and back
            n1 = np.bincount(up2, t2, minlength=len(mid)).astype(np.int64)
            ctx1 = mid // 257
            t1 = seat(n1, p0[up1], np.bincount(ctx1, (n1 > 0), minlength=257)[ctx1], d, s, rng)
            n0 = np.bincount(up1, t1, minlength=257).astype(np.int64)
            t0 = seat(n0, np.full(257, 1 / 257), (n0 > 0).sum(), d, s, rng)
            p0 = predictive(n0, t0, n0.sum(), t0.sum(), 1 / 257, d, s)
            c1, k1 = np.bincount(ctx1, n1, minlength=257), np.bincount(ctx1, t1, minlength=257)
            p1 = predictive(n1, t1, c1[ctx1], k1[ctx1], p0[up1], d, s)
            ctx2, at2 = np.unique(cells // 257, return_inverse=True)
            t2 = seat(n, p1[up2], np.bincount(at2, n > 0)[at2], d, s, rng)
        c2, k2 = np.bincount(at2, n), np.bincount(at2, t2)
        self.p2 = predictive(n, t2, c2[at2], k2[at2], p1[up2], d, s)
        self.mid, self.p1, self.p0 = mid, p1, p0
        self.back1 = (s + d * k1) / (s + c1)
        self.ctx2, self.back2 = ctx2, (s + d * k2) / (s + c2)

    def log_prob(self, cells: np.ndarray) -> np.ndarray:
        """Of each cell's byte after its context."""
        p = self.back1[cells // 257 % 257] * self.p0[cells % 257]
        if len(self.mid):
            k = np.minimum(np.searchsorted(self.mid, cells % 257**2), len(self.mid) - 1)
            p = np.where(self.mid[k] == cells % 257**2, self.p1[k], p)
            k = np.minimum(np.searchsorted(self.ctx2, cells // 257), len(self.ctx2) - 1)
            p = np.where(self.ctx2[k] == cells // 257, self.back2[k] * p, p)
            k = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            p = np.where(self.cells[k] == cells, self.p2[k], p)
        return np.log(p)


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each word's bytes and its stop, and the words' cell counts."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    n = np.diff(offsets) + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(n) else 0, STOP, dtype=np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = data
    at = np.arange(len(out)) - np.repeat(ends - n, n)  # place within the word
    last = np.where(at >= 1, np.r_[STOP, out[:-1]] if len(out) else out, STOP)
    before = np.where(at >= 2, np.r_[STOP, STOP, out[:-2]] if len(out) > 1 else STOP, STOP)
    return (before * 257 + last) * 257 + out, n


def log_spelling(speller: Speller, words: pa.Array) -> np.ndarray:
    cells, n = spell(words)
    return _log_spelling(speller, *np.unique(cells, return_inverse=True), n)


def _log_spelling(speller: Speller, cell: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same of distinct cells (many a word has the same ones) and each byte's place among them."""
    return np.add.reduceat(speller.log_prob(cell)[at], np.cumsum(n) - n) if len(n) else np.zeros(0)


# --- batches and shards ---------------------------------------------------


def _zip(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _zip_sorted(a: np.ndarray) -> bytes:
    return _zip(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def _unzip_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, np.uint64), dtype=np.uint64)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))]))


def _read(shards: int):
    """Rows of two kinds: a batch's documents (shard -1), and its distinct words in one shard."""

    def run(batches):
        ids = (TaskContext.get().partitionId() << 32 | k for k in counter())
        held: list[pa.RecordBatch] = []

        def flush():
            batch = next(ids)
            doc = [x for b in held for x in b.column(0).to_pylist()]
            texts = pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in held])
            lists = word_lists(texts)
            flat = lists.flatten().cast(pa.large_binary())
            owner = np.repeat(np.arange(len(doc)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            full = pa.compute.greater(pa.compute.binary_length(flat), 0)
            flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
            coded = pa.compute.ascii_lower(flat.cast(pa.large_string())).cast(pa.large_binary()).dictionary_encode()
            words = [END, *coded.dictionary.to_pylist()]
            token = coded.indices.to_numpy().astype(np.int64) + 1
            out = np.array([held_out(d) for d in doc], dtype=bool)
            train = np.bincount(token[~out[owner]], minlength=len(words))
            train[0] = (~out).sum()
            shard = np.array([xxhash.xxh32_intdigest(w) % shards for w in words], dtype=np.int64)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            n = np.bincount(owner, minlength=len(doc))
            often = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            payload = {"n": _zip(n), "tokens": _zip(rank[token].astype(np.uint32)), "places": _zip(place[often].astype(np.uint32)), "end": int(place[0])}
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([batch]), pa.array([[]], pa.list_(pa.binary())), pa.array([b""], pa.binary()), pa.array([doc], pa.list_(pa.int64())), pa.array([payload["n"]], pa.binary()), pa.array([payload["tokens"]], pa.binary()), pa.array([payload["places"]], pa.binary()), pa.array([payload["end"]], pa.int64())], NAMES)
            named = pa.array(words, pa.binary()).take(pa.array(order))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = int(cuts[s]), int(cuts[s + 1])
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([batch]), pa.array([named[i:j].to_pylist()], pa.list_(pa.binary())), pa.array([train[order[i:j]].astype(np.int64).tobytes()], pa.binary()), pa.array([[]], pa.list_(pa.int64())), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([i], pa.int64())], NAMES)

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                held.append(whole.slice(k, 256))
                if sum(pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py() or 0 for b in held) >= BATCH:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return run


NAMES = ["shard", "batch", "words", "train", "docs", "n", "tokens", "places", "start"]
READ = "shard int, batch long, words array<binary>, train binary, docs array<long>, n binary, tokens binary, places binary, start long"
MERGED = "shard int, words binary, lengths binary, counts binary, batches array<long>, starts array<long>, asked array<binary>"


def _merge(table: pa.Table) -> pa.Table:
    """One shard's requests as its distinct words with training counts, and each batch's words as places among them."""
    table = table.combine_chunks()
    lists = table["words"].combine_chunks()
    flat = lists.flatten().cast(pa.large_binary())
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy()
    train = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["train"]])
    counts = np.bincount(at, train, minlength=len(coded.dictionary)).astype(np.int64)
    cuts = np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1]
    words = coded.dictionary.to_pylist()
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "words": pa.array([b"".join(words)], pa.binary()),
            "lengths": pa.array([np.array([len(w) for w in words], np.int64).tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "batches": pa.array([table["batch"].to_pylist()], pa.list_(pa.int64())),
            "starts": pa.array([table["start"].to_pylist()], pa.list_(pa.int64())),
            "asked": pa.array([[x.astype(np.uint32).tobytes() for x in np.split(at, cuts)]], pa.list_(pa.binary())),
        }
    )


def _words(row: dict) -> pa.Array:
    lengths = np.frombuffer(row["lengths"], np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64).tobytes()), pa.py_buffer(row["words"])])


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):  # a row is a whole shard: one at a time
            yield b.slice(k, 1).to_pylist()[0]


def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([20240229, *key])


def _spellings(speller: Speller | None, sweep: int, tables: float):
    """Customers of the byte contexts that a shard's tables send up; without a speller each word has one table."""

    def run(batches):
        for row in _rows(batches):
            words, c = _words(row), _unzip(row["n"], np.int64)
            cells, n = spell(words)
            cell, at = np.unique(cells, return_inverse=True)
            t = (c > 0).astype(np.int64) if speller is None else seat(c, np.exp(_log_spelling(speller, cell, at, n)), tables, DISCOUNT, STRENGTH, _rng(sweep, row["shard"]))
            sums = np.bincount(at, np.repeat(t, n))
            yield pa.record_batch([pa.array(np.r_[cell, -1, -2]), pa.array(np.r_[sums, t.sum(), c.sum()].astype(np.int64))], ["cell", "n"])

    return run


def _known(speller: Speller):
    """The known words' share of the speller's probability, by shard."""

    def run(batches):
        for row in _rows(batches):
            words, seen = _words(row), np.frombuffer(row["counts"], np.int64) > 0
            yield pa.record_batch([pa.array([float(np.exp(log_spelling(speller, words))[seen].sum())])], ["mass"])

    return run


# --- restaurants of the words before ----------------------------------------

LOW = np.uint64(2**32 - 1)
NUMBERS = "batch long, start long, numbers binary"
ASKED = "shard int, batch long, pairs binary, train binary"
ASKS = "shard int, batches array<long>, pairs array<binary>, train array<binary>"
#: A shard's pairs seen more than once, and how many words were seen after each of their contexts.
ROOMS = "shard int, pairs binary, counts binary, followers binary"
#: From pair shard ``shard`` to word shard ``word_shard`` (-1: kept for the pairs themselves).
SENT = "shard int, word_shard int, words binary, n binary, wanted binary"
WORDS = "shard int, words binary, lengths binary, counts binary, n binary, rooms array<int>, wanted array<binary>"
SHARES = "shard int, word_shard int, p binary"
ANSWERS = "batch long, kind int, start long, a binary, b binary"


def _numbers(base: dict[int, int]):
    """For each batch: the global numbers of the words it asked a shard for."""

    def run(batches):
        for row in _rows(batches):
            for batch, start, asked in zip(row["batches"], row["starts"], row["asked"], strict=True):
                numbers = np.frombuffer(asked, np.uint32) + np.uint32(base[row["shard"]])
                yield pa.RecordBatch.from_pylist([{"batch": batch, "start": start, "numbers": _zip(numbers)}], pa.schema([("batch", pa.int64()), ("start", pa.int64()), ("numbers", pa.binary())]))

    return run


def _steps(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, context and word (places among the batch's words) of every token, ends included."""
    n = _unzip(row["n"], np.int64)
    token = _unzip(row["places"], np.uint32)[_unzip(row["tokens"], np.uint32)] if n.sum() else np.zeros(0, np.uint32)
    last = np.cumsum(n + 1) - 1
    word = np.full(int(n.sum()) + len(n), row["start"], np.int64)
    inside = np.ones(len(word), bool)
    inside[last] = False
    word[inside] = token
    return np.repeat(np.arange(len(n)), n + 1), np.r_[row["start"], word[:-1]], word  # a text's first word follows an end


def _dealt(pairs: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    u, w = pairs >> np.uint64(32), pairs & LOW
    return (np.where(np.isin(u, hot), w, u) % np.uint64(shards)).astype(np.int64)


def _in_order(row: dict, number: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Texts, contexts and words of the tokens; distinct pairs by shard, their shards, and each token's place among them."""
    doc, context, word = _steps(row)
    pairs, at = np.unique(number[context].astype(np.uint64) << np.uint64(32) | number[word].astype(np.uint64), return_inverse=True)
    shard = _dealt(pairs, hot, shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return doc, context, word, pairs[order], shard[order], place[at]


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    rows = sorted(table.select(["start", column]).to_pylist(), key=lambda r: r["start"])
    return np.concatenate([_unzip(r[column], dtype) for r in rows])


def _pairs(hot: np.ndarray, shards: int):
    """A batch's distinct pairs, by shard, with training counts."""

    def run(docs: pa.Table, numbers: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        doc, _, _, pairs, shard, at = _in_order(row, _joined(numbers, "numbers", np.uint32), hot, shards)
        out = np.array([held_out(d) for d in row["docs"]], dtype=bool)
        train = np.bincount(at[~out[doc]], minlength=len(pairs)).astype(np.uint32)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        return _table([{"shard": s, "batch": row["batch"], "pairs": _zip_sorted(pairs[i:j]), "train": _zip(train[i:j])} for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j], ASKED)

    return run


def _gather(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    return _table([{"shard": rows[0]["shard"], "batches": [r["batch"] for r in rows], "pairs": [r["pairs"] for r in rows], "train": [r["train"] for r in rows]}], ASKS)


def _merged_pairs(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each batch's pairs, the distinct pairs seen in training and their counts."""
    each = [_unzip_sorted(b) for b in row["pairs"]]
    flat, n = np.concatenate(each), np.concatenate([_unzip(b, np.uint32) for b in row["train"]])
    flat, n = flat[n > 0], n[n > 0]
    pairs, at = np.unique(flat, return_inverse=True)
    return each, pairs, np.bincount(at, n, minlength=len(pairs)).astype(np.int64)


def _by_word_shard(bounds: np.ndarray, words: np.ndarray):
    """(word shard, first, last + 1) of sorted word numbers."""
    cuts = np.searchsorted(words, bounds)
    return [(s, i, j) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]


def _rooms(batches):
    for row in _rows(batches):
        _, pairs, c = _merged_pairs(row)
        u, at, followers = np.unique(pairs >> np.uint64(32), return_inverse=True, return_counts=True)
        many = c > 1
        yield from _table([{"shard": row["shard"], "pairs": _zip_sorted(pairs[many]), "counts": _zip(c[many]), "followers": _zip(followers[at[many]].astype(np.int64))}], ROOMS).to_batches()


def _first_sent(bounds: np.ndarray):
    """One table for each pair: its word's customers in the word restaurant, and the words whose probability will be asked for."""

    def run(batches):
        for row in _rows(batches):
            _, pairs, c = _merged_pairs(row)
            words, n = np.unique(pairs & LOW, return_counts=True)
            wanted = np.isin(words, pairs[c > 1] & LOW).astype(np.uint8)
            yield from _table([{"shard": row["shard"], "word_shard": s, "words": _zip_sorted(words[i:j] - np.uint64(bounds[s])), "n": _zip(n[i:j].astype(np.int64)), "wanted": _zip(wanted[i:j])} for s, i, j in _by_word_shard(bounds, words)], SENT).to_batches()

    return run


def _hot_followers(hot: np.ndarray):
    def run(batches):
        for row in _rows(batches):
            u, n = np.unique(_merged_pairs(row)[1] >> np.uint64(32), return_counts=True)
            on = np.isin(u, hot)
            yield pa.record_batch([pa.array(u[on].astype(np.int64)), pa.array(n[on].astype(np.int64))], ["u", "n"])

    return run


def _seat_words(left: pa.Table, right: pa.Table) -> pa.Table:
    """The word restaurant's customers in one shard when every pair has one table."""
    row = left.to_pylist()[0]
    n = np.zeros(len(row["lengths"]) // 8, np.int64)
    rooms, wanted = [], []
    for r in sorted(right.to_pylist(), key=lambda r: r["shard"]):
        at, flag = _unzip_sorted(r["words"]).astype(np.int64), _unzip(r["wanted"], np.uint8) > 0
        n[at] += _unzip(r["n"], np.int64)
        if flag.any():
            rooms.append(r["shard"])
            wanted.append(_zip_sorted(at[flag]))
    return _table([{**row, "n": _zip(n), "rooms": rooms, "wanted": wanted}], WORDS)


def _more_words(left: pa.Table, right: pa.Table) -> pa.Table:
    """The same with the tables that pairs have beyond the first."""
    row = left.to_pylist()[0]
    n, wanted = _unzip(row["n"], np.int64).copy(), dict(zip(row["rooms"], row["wanted"], strict=True))
    for r in right.to_pylist():
        n[_unzip_sorted(wanted[r["shard"]]).astype(np.int64)] += _unzip(r["n"], np.int64)
    return _table([{**row, "n": _zip(n)}], WORDS)


def _shares(speller: Speller, sweep: int, n: float, tables: float, unknown: float):
    """Probabilities in the word restaurant: of all words of a shard (shard -1), and of those that each pair shard wants."""

    def run(batches):
        for row in _rows(batches):
            words, c = _words(row), _unzip(row["n"], np.int64)
            base = np.where(c > 0, np.exp(log_spelling(speller, words)), unknown)
            t = seat(c, base, tables, DISCOUNT, STRENGTH, _rng(1000 + sweep, row["shard"]))
            p = predictive(c, t, n, tables, base, DISCOUNT, STRENGTH).astype(np.float32)
            out = [{"shard": -1, "word_shard": row["shard"], "p": _zip(p)}]
            out += [{"shard": r, "word_shard": row["shard"], "p": _zip(p[_unzip_sorted(w).astype(np.int64)])} for r, w in zip(row["rooms"], row["wanted"], strict=True)]
            yield from _table(out, SHARES).to_batches()

    return run


def _seat_pairs(sweep: int, bounds: np.ndarray, hot: np.ndarray, hot_tables: np.ndarray):
    """Tables beyond each pair's first: kept for the pairs (word shard -1), and summed by word for the word shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pairs, c, followers = _unzip_sorted(row["pairs"]), _unzip(row["counts"], np.int64), _unzip(row["followers"], np.int64)
        if not len(pairs):
            return _table([{"shard": row["shard"], "word_shard": -1, "words": None, "n": _zip(c), "wanted": None}], SENT)
        words, at = np.unique(pairs & LOW, return_inverse=True)
        p = np.concatenate([_unzip(r["p"], np.float32) for r in sorted(right.to_pylist(), key=lambda r: r["word_shard"])]).astype(float)[at]
        u, room = np.unique(pairs >> np.uint64(32), return_inverse=True)
        rng, total = _rng(2000 + sweep, row["shard"]), followers
        central = np.isin(u, hot)[room]
        if central.any():
            total = total.copy()
            total[central] = hot_tables[np.searchsorted(hot, u[room[central]])]
        more = seat(c, p, total, PAIR_DISCOUNT, PAIR_STRENGTH, rng) - 1
        again = np.where(central, total, followers + np.bincount(room, more)[room].astype(np.int64))
        more = seat(c, p, again, PAIR_DISCOUNT, PAIR_STRENGTH, rng) - 1
        sums = np.bincount(at, more).astype(np.int64)
        out = [{"shard": row["shard"], "word_shard": s, "words": None, "n": _zip(sums[i:j]), "wanted": None} for s, i, j in _by_word_shard(bounds, words)]
        return _table([{"shard": row["shard"], "word_shard": -1, "words": None, "n": _zip(more), "wanted": None}, *out], SENT)

    return run


def _hot_more(hot: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        u, more = _unzip_sorted(left["pairs"][0].as_py()) >> np.uint64(32), _unzip(right["n"][0].as_py(), np.int64)
        on = np.isin(u, hot)
        names, at = np.unique(u[on], return_inverse=True)
        return _table([{"u": int(x), "n": int(y)} for x, y in zip(names, np.bincount(at, more[on], minlength=len(names)), strict=True)], "u long, n long")

    return run


def _word_answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each batch that asked a shard: its words' training counts, and their probabilities in every kept sweep."""
    row = left.to_pylist()[0]
    c = np.frombuffer(row["counts"], np.int64)
    p = np.stack([_unzip(r["p"], np.float32) for r in sorted(right.to_pylist(), key=lambda r: r["sweep"])], axis=1)
    asked = ((b, s, np.frombuffer(x, np.uint32)) for b, s, x in zip(row["batches"], row["starts"], row["asked"], strict=True))
    return _table([{"batch": b, "kind": 0, "start": s, "a": _zip(c[at]), "b": _zip(p[at].ravel())} for b, s, at in asked], ANSWERS)


def _pair_answers(hot: np.ndarray, hot_tables: list[np.ndarray]):
    """For each batch that asked a shard: its pairs' customers less discounts, and the tables of each context that it asked for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        each, pairs, c = _merged_pairs(row)
        more = [_unzip(r["n"], np.int64) for r in sorted(right.to_pylist(), key=lambda r: r["sweep"])]
        mass = c - PAIR_DISCOUNT * np.ones(len(c))
        mass[c > 1] -= PAIR_DISCOUNT * sum(more) / len(more)
        u, room, followers = np.unique(pairs >> np.uint64(32), return_inverse=True, return_counts=True)
        tables = np.stack([followers + np.bincount(room[c > 1], m, minlength=len(u)) for m in more], axis=1).astype(np.int64)
        on = np.isin(u, hot)
        for k, total in enumerate(hot_tables):
            tables[on, k] = total[np.searchsorted(hot, u[on])]
        mass, tables = np.r_[mass, 0.0].astype(np.float32), np.r_[tables, np.zeros((1, len(more)), np.int64)]
        out = []
        for batch, asked in zip(row["batches"], each, strict=True):
            at = np.searchsorted(pairs, asked)
            at[(pairs[np.minimum(at, len(pairs) - 1)] if len(pairs) else np.zeros(len(at), np.uint64)) != asked] = len(pairs)
            context = np.unique(asked >> np.uint64(32))
            where = np.searchsorted(u, context)
            where[(u[np.minimum(where, len(u) - 1)] if len(u) else np.full(len(where), LOW)) != context] = len(u)
            out.append({"batch": batch, "kind": 1, "start": row["shard"], "a": _zip(mass[at]), "b": _zip(tables[where].ravel())})
        return _table(out, ANSWERS)

    return run


def _score(train_tokens: int, vocabulary: int, kept: int, hot: np.ndarray, shards: int):
    whole = math.log10(train_tokens + 0.1 * (vocabulary + 1))

    def run(docs: pa.Table, numbers: pa.Table) -> pa.Table:
        row, kind = docs.to_pylist()[0], numbers["kind"].to_numpy()
        named, words, rooms = (numbers.filter(pa.array(kind == k)) for k in (2, 0, 1))
        c, p = _joined(words, "a", np.int64), _joined(words, "b", np.float32).reshape(-1, kept)
        doc, context, word, pairs, shard, at = _in_order(row, _joined(named, "a", np.uint32), hot, shards)
        mass, tables = _joined(rooms, "a", np.float32), _joined(rooms, "b", np.int64).reshape(-1, kept)
        u = pairs >> np.uint64(32)
        room = np.cumsum(np.r_[True, (u[1:] != u[:-1]) | (shard[1:] != shard[:-1])]) - 1  # contexts as the shards listed them
        total = np.bincount(doc, minlength=len(row["docs"])) * 0.0
        base, known = total.copy(), np.bincount(doc, c[word] > 0, minlength=len(total)).astype(np.int64)
        for i in range(0, len(doc), 500_000):
            d, w, x, y = doc[i : i + 500_000], word[i : i + 500_000], context[i : i + 500_000], at[i : i + 500_000]
            back = ((PAIR_STRENGTH + PAIR_DISCOUNT * tables[room[y]]) * p[w]).mean(axis=1)
            total += np.bincount(d, np.log10(np.maximum((mass[y] + back) / (PAIR_STRENGTH + c[x]), 1e-300)), minlength=len(total))
            base += np.bincount(d, np.log10(c[w] + 0.1) - whole, minlength=len(total))
        out = [held_out(d) for d in row["docs"]]
        n = np.bincount(doc, minlength=len(total)).astype(np.int64)
        names = [x.split()[0] for x in SCORES.split(", ")]
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(out), pa.array(n), pa.array(known), pa.array([train_tokens] * len(n), pa.int64()), pa.array(base), pa.array(total)], names)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    shards = max(8, 2 * texts.rdd.getNumPartitions())  # follows the input's size
    store = common.keep(texts.mapInArrow(_read(shards), READ), "lm-read")
    asked = store.where("shard >= 0").select("shard", "batch", "words", "train", "start")
    merged = common.keep(asked.groupBy("shard").applyInArrow(_merge, MERGED), "lm-shards")
    parts = common.keep(store.where("shard < 0").select("batch", "docs", "n", "tokens", "places", "start"), "lm-texts")
    common.drop(store)  # what a step has used up doesn't wait on disk for the end

    def sizes(batches):
        for row in _rows(batches):
            c = np.frombuffer(row["counts"], np.int64)
            yield pa.record_batch([pa.array([row["shard"]], pa.int32()), pa.array([len(c)]), pa.array([int(c.sum())]), pa.array([int((c > 0).sum())])], ["shard", "size", "n", "v"])

    vocabulary = merged.select("shard", "words", "lengths", "counts")
    size = {r["shard"]: r for r in vocabulary.mapInArrow(sizes, "shard int, size long, n long, v long").collect()}
    n, v = sum(r["n"] for r in size.values()), sum(r["v"] for r in size.values())
    bounds = np.cumsum([0] + [size[s]["size"] if s in size else 0 for s in range(shards)])
    base = {s: int(bounds[s]) for s in range(shards)}
    if bounds[-1] >= 2**32:
        raise ValueError("more than 2**32 distinct words")

    least = max(n / (HOT_EACH * shards), HOT_LEAST)

    def frequent(batches):
        for row in _rows(batches):
            c = np.frombuffer(row["counts"], np.int64)
            at = np.flatnonzero(c > least)
            yield pa.record_batch([pa.array(at + base[row["shard"]])], ["u"])

    hot = np.array(sorted(r["u"] for r in vocabulary.mapInArrow(frequent, "u long").collect()), np.uint64)
    numbers = merged.select("shard", "batches", "starts", "asked").mapInArrow(_numbers(base), NUMBERS)
    asked = parts.groupBy("batch").cogroup(numbers.groupBy("batch")).applyInArrow(_pairs(hot, shards), ASKED)
    asks = common.keep(asked.groupBy("shard").applyInArrow(_gather, ASKS), "lm-pairs")
    rooms = common.keep(asks.mapInArrow(_rooms, ROOMS), "lm-rooms")
    sent = asks.mapInArrow(_first_sent(bounds), SENT)
    first = common.keep(vocabulary.groupBy("shard").cogroup(sent.groupBy("word_shard")).applyInArrow(_seat_words, WORDS), "lm-words")

    def central(sums: DataFrame) -> np.ndarray:
        found = {r["u"]: r["n"] for r in sums.groupBy("u").agg(F.sum("n").alias("n")).collect()}
        return np.array([found.get(int(u), 0) for u in hot], np.int64)

    followers = central(asks.mapInArrow(_hot_followers(hot), "u long, n long")) if len(hot) else np.zeros(0, np.int64)
    words, hot_tables, speller, all_tables = first, followers, None, float(v)
    kept, more, hots = [], [], []
    for sweep in range(SWEEPS):
        if sweep:
            sums = common.keep(rooms.groupBy("shard").cogroup(shares.where("shard >= 0").groupBy("shard")).applyInArrow(_seat_pairs(sweep, bounds, hot, hot_tables), SENT), "lm-tables")
            own = sums.where("word_shard < 0").select("shard", F.lit(sweep).alias("sweep"), "n")
            if len(hot):
                hot_tables = followers + central(rooms.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_hot_more(hot), "u long, n long"))
            common.drop(shares)
            words = common.keep(first.groupBy("shard").cogroup(sums.where("word_shard >= 0").groupBy("word_shard")).applyInArrow(_more_words, WORDS), "lm-words")
        cells = words.mapInArrow(_spellings(speller, sweep, all_tables), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").toPandas().sort_values("cell")
        all_tables, customers = (float(cells.loc[cells["cell"] == k, "n"].sum()) for k in (-1, -2))
        cells = cells[cells["cell"] >= 0]
        speller = Speller(cells["cell"].to_numpy(), cells["n"].to_numpy(), _rng(sweep, -1 % 2**32))
        known = vocabulary.mapInArrow(_known(speller), "mass double").agg(F.sum("mass")).first()[0] or 0.0
        shares = common.keep(words.mapInArrow(_shares(speller, sweep, customers, all_tables, max(1e-9, 1 - known)), SHARES), "lm-shares")
        if sweep:
            common.drop(words)
        if sweep >= BURN_IN:
            kept.append(common.keep(shares.where("shard < 0").select(F.col("word_shard").alias("shard"), F.lit(sweep).alias("sweep"), "p"), "lm-kept"))
            more.append(own)
            hots.append(hot_tables)
    common.drop(shares, first, rooms)
    every = lambda tables: functools.reduce(DataFrame.union, tables)
    answers = merged.groupBy("shard").cogroup(every(kept).groupBy("shard")).applyInArrow(_word_answers, ANSWERS)
    answers = answers.union(asks.groupBy("shard").cogroup(every(more).groupBy("shard")).applyInArrow(_pair_answers(hot, hots), ANSWERS))
    answers = answers.union(numbers.select("batch", F.lit(2).alias("kind"), "start", F.col("numbers").alias("a"), F.lit(None).cast("binary").alias("b")))
    return parts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(n, v, len(kept), hot, shards), SCORES)
