"""Quality rules (7), DataFrame functions only: counts of words, symbols and repeats, then a hashed n-gram
log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. The raw multinomial counts every
document; the target multinomial counts those of at most ``TARGETS`` documents labelled as good (the ones
with the least id hash). Each bucket's log ratio is rounded to a whole number of millionths,
so a document's sum is exact whatever the order, and its mean over n-grams against ``THRESHOLD`` is a
deterministic verdict.

Null text counts as having no words. Null ids match no label; rows that repeat an id are each judged by
their own text. Without labelled documents all ratios are 0 and the base rules alone decide. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
TARGETS = 20_000
#: Mean log ratio (in nats) below which a document goes.
THRESHOLD = -0.1
#: Added to every raw count; and what a bucket gets on average, by raw shares, on top of its target count, so that a small target
#: says little instead of speaking against every text outside it.
SMOOTH, PRIOR = 1.0, 10.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 1_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LOW = (1 << 24) - 1  # positions that share a long with the upper bits of a window's hash


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{common.SPACE}]+", -1), lambda w: w != "")


def _repeat_words(w: Column) -> Column:
    """Words within 3-word windows that the text holds twice or more.

    Sorting (hash prefix, position) longs puts equal windows next to each other; whole hashes then decide. Where two windows share a
    prefix only, or positions don't fit beside it, (hash, position) pairs are sorted instead: slower, and right for any text.
    """
    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    upper = ~LOW
    no = F.lit(False)

    def words_of(starts):
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def by_pairs(h):
        def flagged(p):
            same = lambda x, y: F.coalesce(x["h"] == y["h"], no)
            return words_of(F.transform(F.filter(p, lambda x, i: same(x, F.get(p, i + 1)) | same(x, F.get(p, i - 1))), lambda x: x["i"]))

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), flagged)

    def covered(h):
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(upper)).bitwiseOR(i.cast("long"))))

        def flagged(p):
            at = lambda x: F.get(h, x.bitwiseAND(F.lit(LOW)).cast("int"))
            near = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(upper)) == 0, no)
            hit = F.filter(p, lambda x, i: near(x, F.get(p, i + 1)) | near(x, F.get(p, i - 1)))
            mixed = F.exists(F.transform(p, lambda x, i: near(x, F.get(p, i + 1)) & (at(x) != at(F.get(p, i + 1)))), lambda x: F.coalesce(x, no))
            return F.when(mixed, by_pairs(h)).otherwise(words_of(F.transform(hit, lambda x: x.bitwiseAND(F.lit(LOW)).cast("int"))))

        return F.when(F.size(h) > LOW, by_pairs(h)).otherwise(let(packed, flagged))

    return F.when(F.size(w) < 6, F.when(F.size(w) < 4, 0).otherwise(_few(w))).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    )


def _few(w: Column) -> Column:
    """Four or five words have two or three windows; overlapping ones can be equal too."""
    window = lambda i: F.concat_ws(" ", F.get(w, F.lit(i)), F.get(w, F.lit(i + 1)), F.get(w, F.lit(i + 2)))
    five = F.size(w) == 5
    a, b, c = (window(0) == window(1)), five & (window(1) == window(2)), five & (window(0) == window(2))
    return F.when((a & b) | c, 5).when(a | b, 4).otherwise(0)


def base(text: Column, w: Column) -> Column:
    """Struct of the base counts, from a text and its words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{common.SPACE}]"))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )


def grams(w: Column, buckets: int) -> Column:
    """Buckets of all words and neighbouring pairs."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, targets: int = TARGETS) -> np.ndarray:
    """Log ratio of every bucket, in millionths. Only ``buckets`` count rows reach the driver."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = F.broadcast(good.orderBy(F.xxhash64("good_id"), "good_id").limit(targets).withColumn("good", F.lit(1)))
    flagged = docs.select(F.col("doc_id").cast("long").alias("good_id"), F.col("text").cast("string").alias("text")).join(good, "good_id", "left")
    found = flagged.select("good", F.explode(let(words(F.col("text")), lambda w: grams(w, buckets))).alias("b"))
    raw, target = np.full(buckets, SMOOTH), np.zeros(buckets)
    counted = False
    for b, n, g in found.groupBy("b").agg(F.count("*"), F.count("good")).collect():
        raw[b] += n
        target[b] += g
        counted |= g > 0
    if not counted:
        return np.zeros(buckets, dtype=np.int64)
    raw /= raw.sum()
    target += PRIOR * buckets * raw
    return np.rint((np.log(target / target.sum()) - np.log(raw)) * SCALE).astype(np.int64)


def judged(docs: DataFrame, labels: DataFrame, name: str, buckets: int = BUCKETS, targets: int = TARGETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``name``: the base counts, ``n_grams``, ``ratio`` (millionths, summed), ``base_failed``, ``kept``."""
    weights = F.lit(ratios(docs, labels, buckets, targets))
    least = math.floor(threshold * SCALE)
    text = F.col("text").cast("string")

    def verdict(w):
        def total(g):
            return F.struct(F.size(g).cast("long").alias("n_grams"), F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b)).alias("ratio"))

        return F.struct(base(text, w).alias("base"), let(grams(w, buckets), total).alias("llr"))

    def close(v):
        b, r = v["base"], v["llr"]
        failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * b["n_words"])
        return F.struct(*[b[c].alias(c) for c in BASE], r["n_grams"].alias("n_grams"), r["ratio"].alias("ratio"), failed.alias("base_failed"), (~failed & (r["ratio"] >= least * r["n_grams"])).alias("kept"))

    return docs.withColumn(name, let(let(words(text), verdict), close))
