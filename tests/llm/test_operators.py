"""Each operator on odd input (nulls, empty and long texts, repeats, clashing columns, empty tables) and against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import byte_bpe, chat, common, exact_search, language_model, licenses, line_dedup, near_dedup, packing, pii, quality, queries, word_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 7001}x" for k in range(30_000))
LINE = "A line that three or more documents hold."
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "İstanbul ÀÉ é 日本語 don't 🎉"), (5, LONG), (6, LONG + " end"), (7, f"one\n{LINE}\ntwo"), (8, f"{LINE}\nthree"),
    (9, f"  {LINE.upper()}  \nfour"), (9, f"  {LINE.upper()}  \nfour"), (None, f"{LINE}\nfive"), (10, "mail a.b@c.example.org or +1 (650) 555-1234, 4111111111111111 from 10.0.0.1"), (11, "<|endoftext|> a<|startoftext|>b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")


def clashing(df):
    names = "n_lines n_dropped verdict line_d line_drop line_r near_key q row c h class_id label bin fill words DOC".split()
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


# --- 9 ----------------------------------------------------------------------


def plain_line_dedup(rows):
    docs, best = collections.defaultdict(set), {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line_dedup.line_key(line)
            if len(key) >= 20:
                docs[key].add(-math.inf if d is None else d)
    best = {k: max(v) for k, v in docs.items() if len(v) >= 3}
    return sorted((repr(d), "\n".join(x for x in (t or "").split("\n") if best.get(line_dedup.line_key(x), d if d is not None else -math.inf) == (d if d is not None else -math.inf))) for d, t in rows)


def test_line_dedup(odd, none):
    out = line_dedup.drop_lines(clashing(odd))
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in out.collect()) == plain_line_dedup(ODD)
    assert out.columns[-2:] == ["n_lines", "n_dropped"] and out.where("doc_id = 1 and text is null").count() == 1
    assert [r["n_dropped"] for r in out.where("doc_id = 7").collect()] == [1]
    kept = line_dedup.drop_lines(clashing(odd), counts=False)
    assert kept.columns == clashing(odd).columns and kept.select("n_lines").distinct().collect() == [("own n_lines",)]
    assert line_dedup.drop_lines(none).count() == 0


def test_hot_lines_are_dealt_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES", 5)  # one line takes 200 probe tasks
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 300)
    rows = [(k, f"{LINE}\nown line number {k // 2} of its own") for k in range(1000)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((repr(r["doc_id"]), r["text"]) for r in out.collect()) == plain_line_dedup(rows)


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 50_000).astype(np.uint64)
    h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert len(line_dedup.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


# --- 1 ----------------------------------------------------------------------


def test_best_fit():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 61, 500)
    bins, at, fill = packing.best_fit(n, 100)
    for b in range(len(fill)):
        inside = sorted((at[k], n[k]) for k in np.flatnonzero(bins == b))
        assert [x for x, _ in inside] == np.cumsum([0, *[y for _, y in inside]])[:-1].tolist() and fill[b] == sum(y for _, y in inside) <= 100
    assert len(fill) <= 1.05 * n.sum() / 100 + 1


def test_packing(odd, none, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 3)  # several bins a task and several rounds
    rows = packing.pack(clashing(odd).repartition(3), WORDS, 512).collect()
    full = word_tokens.load(WORDS).full
    want = []
    for d, t in ODD:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(repr(d), k, 512 * k, len(p := ids[512 * k : 512 * k + 512]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // 512))]
    assert sorted((repr(r["doc_id"]), *r[1:5]) for r in rows) == sorted(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= 512
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 512 + 1
    assert packing.pack(none, WORDS).count() == 0


def test_word_ids_are_the_library_s(spark, sf):
    w = word_tokens.load(WORDS)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(1)
    pieces = ["a", "B", "it's", "'S", "é", "é", "İ", "Σς", "日本", "１", "12", "!?", " ", "\n", "\x85", "\xa0", "　", "\x1c", "\x01", "<|endoftext|>", "ǅ", "ɐ", "-", "_"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(w.encode(t.encode()), "<u4").tolist() == w.full.encode(t, add_special_tokens=False).ids, repr(t)


# --- 2 ----------------------------------------------------------------------


def test_byte_bpe(odd, none):
    import tiktoken

    pattern = public_tokenizers.PATTERN
    bpe = byte_bpe.load(RANKS, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(clashing(odd), RANKS, pattern), RANKS, pattern).collect()
    assert sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in rows) == sorted((repr(d), enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in ODD)
    assert byte_bpe.encode(none, RANKS, pattern).count() == 0
    rng = random.Random(2)
    pieces = ["a", "bc", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "é", "日本", "1", "23", "!", "🎉", "\x00", "　", "▁", "<unk>", "</s>"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        ids = np.frombuffer(bpe.encode(t), "<u4").tolist()
        assert ids == enc.encode_ordinary(t) and bpe.decode(ids) == t.encode(), repr(t)


def test_byte_bpe_decodes_whole_batches(sf):
    """Slices, null and empty lists; what isn't a rank is refused; no id becomes a Python object, so decoding takes a small part of encoding's time."""
    import time

    import pyarrow.parquet as pq

    bpe = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    ids = pa.array([[1, 2], None, [], [300, 301, 5], [49999]], pa.list_(pa.int32()))
    raw = sorted(bpe.ranks, key=bpe.ranks.get)
    want = [raw[1] + raw[2], b"", b"", raw[300] + raw[301] + raw[5], raw[49999]]
    for a in range(6):
        for n in range(6 - a):
            assert bpe.decode_batch(ids.slice(a, n)).to_pylist() == want[a : a + n]
    for wrong in ([-1], [len(raw)], [1, None]):
        with pytest.raises((IndexError, ValueError)):
            bpe.decode(wrong)
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    t0 = time.process_time()
    encoded = pa.record_batch([pa.array(range(len(texts)), pa.int64()), bpe.encode_batch(texts)], ["doc_id", "ids"])
    t1 = time.process_time()
    assert bpe.decode_batch(encoded.column(1)).to_pylist() == [t.encode() for t in texts]
    assert time.process_time() - t1 < (t1 - t0) / 4


def test_byte_bpe_round_trip(spark, sf, odd):
    """The rows of encode and decode, and one Python step where they have two."""
    two = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    one = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert queries.op2_byte_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# --- 3 ----------------------------------------------------------------------


def test_chat_views(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, 300, "ann", "late"), (2, 0, "bob", ""), (None, None, None, "x"), (3, 0, "system", "alone"), (4, 0, "ann", "twice"), (4, 0, "ann", "twice")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "participant", "turns", "lines", "of", "own", "mask", "start")})
    out = {(r["conv_id"], r["participant"], r["part"]): r for r in chat.views(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (2, "ann", 0), (2, "bob", 0), (None, "unknown", 0), (4, "ann", 0)}
    r = out[1, "ann", 0]
    assert r["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    spans = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",")]
    assert [r["rendered"][a:b] for a, b in spans] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    assert out[2, "ann", 0]["n_turns"] == out[4, "ann", 0]["n_turns"] == 2
    assert out[2, "bob", 0]["rendered"][slice(*map(int, out[2, "bob", 0]["mask"].split(":")))] == "<|im_end|>\n"
    assert chat.views(df.limit(0)).count() == 0


def test_long_dialogues_are_one_text(spark):
    """However its rows are cut, the same text and mask; a dialogue of 300 turns with wide numbers is one row."""
    rng = random.Random(5)
    turns = [(c, rng.choice([None, k // 2 * 1000]), rng.choice(["system", "ann", "bob", "Zoë", None]), f"t{rng.randrange(99)}é") for c in (None, 1, 2) for k in range(300 if c else 40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["participant"]): r for r in chat.views(df).collect()}
    assert len(whole) == 12 and {r["part"] for r in whole.values()} == {0} and whole[1, "ann"]["n_turns"] == 300
    pieces = collections.defaultdict(list)
    for r in chat.views(df, longest=7).orderBy("part").collect():
        assert r["start"] == sum(len(x["rendered"]) for x in pieces[r["conv_id"], r["participant"]]) and r["n_turns"] <= 7
        pieces[r["conv_id"], r["participant"]].append(r)
    for key, r in whole.items():
        assert "".join(x["rendered"] for x in pieces[key]) == r["rendered"]
        assert ",".join(x["mask"] for x in pieces[key] if x["mask"]) == r["mask"]


# --- 4 ----------------------------------------------------------------------


def plain_top_k(rows, every, k):
    """By row: ids and vectors of whole numbers, every pair, in Python's integers."""
    fine = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if d is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q % every == 0:
            each = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), d) for m, (d, b) in enumerate(fine) if m != n)[:k]
            out += [(q, r, d, -s) for r, (s, d) in enumerate(each, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.3, 0.0])
def test_exact_search(spark, monkeypatch, spread):
    monkeypatch.setattr(exact_search, "SHARD", 90)
    monkeypatch.setattr(exact_search, "BLOCK", 5)
    monkeypatch.setattr(exact_search, "TOGETHER", 2)
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(size=(300, 8)) * spread + 0.1, np.full((60, 8), 0.25)])
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    rows += [(1000, None), (1100, [None] * 8), (1150, [math.nan] * 8), (1200, [math.inf] * 8), (1220, [1e308]), (None, [0.5] * 8)]  # take no part
    odd = [(1050, []), (1060, []), (1250, [1e30] * 8), (1260, [-1e30] + [1.0] * 7), (1280, [1e6, 1.0]), (1300, [3e4, -2.5] * 4), (7, [0.5] * 8), (20, [0.75] * 8), (20, [-0.75] * 8)]
    for more in ([], odd):
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("x", "row", "part", "shard", "ids", "rank")})
        assert sorted(map(tuple, exact_search.top_k(df, 20, 4).collect())) == plain_top_k(rows + more, 20, 4)
    assert exact_search.top_k(df.limit(0), 20, 4).count() == 0
    few = [(k, [0.5]) for k in range(3)]
    assert exact_search.top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>"), 1, 5).count() == 6


# --- 5 ----------------------------------------------------------------------


def test_language_model(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    counts, tokens = collections.Counter(), {}
    for d, t in docs.select("doc_id", "text").collect():
        tokens[d] = [*t.encode().lower().split(), b""]
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, w in tokens.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # a lower perplexity than smoothed counts
    out = language_model.score(clashing(odd)).collect()
    assert sorted(repr(r["doc_id"]) for r in out) == sorted(repr(d) for d, _ in ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_score_depends_on_word_order(spark, monkeypatch, hot):
    if hot:  # every context dealt over shards
        monkeypatch.setattr(language_model, "HOT_EACH", 100)
        monkeypatch.setattr(language_model, "HOT_LEAST", 1)
    rng = random.Random(5)
    train = [k for k in range(1, 2000) if not language_model.held_out(k)][:400]
    rows = [(d, " ".join(f"a{j} b{j}" for j in (rng.randrange(50) for _ in range(40)))) for d in train]
    held = [k for k in range(3000, 4000) if language_model.held_out(k)][:2]
    rows += [(held[0], " ".join(f"a{j} b{j}" for j in range(20))), (held[1], " ".join(f"b{j} a{j}" for j in range(20)))]
    out = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out[held[0]]["base_score"] == pytest.approx(out[held[1]]["base_score"])
    assert out[held[0]]["score"] > out[held[1]]["score"] + 20  # b after its a is all but certain
    assert -1.9 < out[held[0]]["score"] / 40 < -0.8  # half of the words are one of 50, the others certain


def test_words_sum_to_one():
    import pyarrow as pa

    words = [b"", b"ab", b"abc", b"b", "é".encode()]
    cells, n = language_model.spell(pa.array(words, pa.large_binary()))
    assert n.tolist() == [1, 3, 4, 2, 3] and (cells % 257)[np.cumsum(n) - 1].tolist() == [language_model.STOP] * 5
    u, at = np.unique(cells, return_inverse=True)
    s = language_model.Speller(u, np.bincount(at).astype(np.int64), np.random.default_rng(0))
    for context in (language_model.STOP * 257 + ord("a"), ord("x") * 257 + ord("b"), 5 * 257 + 6):
        assert np.exp(s.log_prob(context * 257 + np.arange(257))).sum() == pytest.approx(1)
    t = language_model.seat(np.array([0, 1, 5, 100_000]), np.full(4, 0.25), 4.0, 0.5, 1.0, np.random.default_rng(1))
    assert t[0] == 0 and t[1] == 1 and (t <= [0, 1, 5, 100_000]).all()


# --- 6 ----------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "1", "12", "255", "4111111111111111", "+", " ", "-", "(", ")", "a", "b.c", "+1 ", "\n", "é", "_", "%", "１"]
    for _ in range(8000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_random_field():
    model = pii.train()
    right = wrong = missed = 0
    for text, spans in pii.examples(300, 12345):  # not those of training
        got, want = set(pii.find(text, model)[1]), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.9
    assert pii.find("call +1 (826) 555-4081 190.137.1.20 now", model)[1] == [(5, 22, 3), (23, 35, 1)]  # the pattern alone drops this phone
    for clean in ("nothing here", "version 3.0 of 2024-05-06, page 12", "a sum of 1,234,567 in 12:30:45"):
        assert pii.find(clean, model) == ([], [])


def test_best_segmentation_against_enumeration():
    """The dynamic program's segments have the highest total of all ways to choose disjoint candidates."""
    model = pii.train()
    for text, _ in pii.examples(60, 4321):
        for tokens in pii.windows(text):
            found = [(i, j, *model.score(text, tokens[i][0], tokens[j - 1][1])) for i, j in pii.segments(text, tokens)]
            good = [x for x in found if x[3] > -2][:14]  # all that could be chosen, and some that couldn't

            def best(at, end):
                if at == len(good):
                    return 0.0
                i, j, _, s = good[at]
                rest = best(at + 1, end)
                return max(rest, s + best(at + 1, j)) if i >= end else rest

            good.sort()
            chosen = model.best(text, tokens, -math.inf)
            scores = {(tokens[i][0], tokens[j - 1][1]): s for i, j, _, s in found}
            if len([x for x in found if x[3] > -2]) <= 14:
                assert sum(scores[a, b] for a, b, _ in chosen) == pytest.approx(best(0, 0))
            assert [x for x in chosen if scores[x[:2]] >= pii.ODDS] == model.best(text, tokens)


def test_loose_addresses_of_any_length():
    model = pii.train()
    for address in ("smith(at)mail(dot)org", "smith [at] mail [dot] org", "s" * 300 + "_smith[at]mail.org", "jo.do(at)" + "mail" * 40 + "(dot)org"):
        for text in (address, f"write {address} now", f"{'word ' * 50}\n{address}, he said"):
            assert [text[a:b] for a, b, _ in pii.find(text, model)[1]] == [address]
    assert pii.find("they met at noon (at) the gate, dot by dot", model) == ([], [])


def test_pii(odd, none):
    rows = {repr(r["doc_id"]): r for r in pii.detect(clashing(odd)).collect()}
    assert len(rows) == len(ODD) - 1 and rows["1"]["spans"] == "" and rows["10"]["base"].count(":") == 8
    masked = pii.mask(clashing(odd))
    assert masked.columns == clashing(odd).columns
    assert [r["text"] for r in masked.where("doc_id = 10").collect()] == ["mail [EMAIL] or [PHONE], [CARD] from [IP]"]
    assert masked.where("text is null").count() == 1 and pii.mask(none).count() == 0 and pii.detect(none).count() == 0


# --- 7 ----------------------------------------------------------------------


def plain_base(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(three)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len({j for k, t in enumerate(three) if often[t] > 1 for j in (k, k + 1, k + 2)})


def test_quality_counts(spark, labels):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "a\n", "#", "c|", "\t", "é ", "a a a "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, LONG, "x " * 20_000])], "doc_id long, text string")
    for r in quality.judged(df, labels, "v").select("text", "v.*").collect():
        assert tuple(r[c] for c in quality.BASE) == plain_base(r["text"]), r["text"][:80]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_quality_verdict(spark, sf, odd, none, labels):
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judged(docs, known, "v").join(known, "doc_id").where("not v.base_failed").select("quality", "v.kept").collect()
    good, bad = [r["kept"] for r in out if r["quality"] == 1], [r["kept"] for r in out if r["quality"] == 0]
    assert np.mean(good) == 1.0 and np.mean(bad) < 0.5
    odd_out = quality.judged(clashing(odd), labels, "v")
    assert odd_out.count() == len(ODD) and odd_out.where("doc_id = 1 and v.kept").count() == 0
    assert quality.judged(none, labels, "v").count() == 0
    assert quality.judged(odd, labels.limit(0), "v").where("v.kept = v.base_failed").count() == 0  # no target: only base rules


@pytest.mark.parametrize("low", [None, 3, (1 << 62) - 1])
def test_repeated_words_at_any_length(spark, monkeypatch, low):
    """Positions that don't fit beside a hash, and windows that share a prefix only (all do when no bits of the hash are left)."""
    if low is not None:
        monkeypatch.setattr(quality, "LOW", low)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 3, 5, 6, 9, 30, 200)] + [" ".join(f"w{rng.randrange(40)}" for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["n"] for r in df.select(quality._repeat_words(quality.words(F.col("text"))).alias("n")).collect()]
    want = []
    for t in texts:
        w = t.split()
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        want.append(len({k + x for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for x in range(3)}))
    assert got == want


def test_ratios_are_plain_counts(spark, labels):
    df = spark.createDataFrame([(5, "a b"), (1, "b b c")], "doc_id long, text string")
    got = quality.ratios(df, labels, 64)
    grams = {r["doc_id"]: r["g"] for r in df.select("doc_id", quality.grams(quality.words(F.col("text")), 64).alias("g")).collect()}
    raw, target = np.ones(64), np.zeros(64)
    np.add.at(raw, grams[5] + grams[1], 1)
    np.add.at(target, grams[5], 1)
    raw /= raw.sum()
    target += quality.PRIOR * 64 * raw
    assert got.tolist() == np.rint((np.log(target / target.sum()) - np.log(raw)) * 1e6).astype(int).tolist()


# --- 8 ----------------------------------------------------------------------


def test_licenses(spark, none):
    texts = {
        1: "prose here\nReleased under the MIT License.\nmore", 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 2.",
        4: "LICENSED!! UNDER!! CC!! BY-NC!! 4.0!!", 5: "He renewed the licence and the license of others.", 6: None, 7: "", 8: "Licensed under the Apache License, Version 3.0.",
        9: "Released under the MIT License.\nLicensed under CC BY 4.0.", 10: LONG + "\nThis work is licensed under the GNU General Public Licence, version 3.\n" + LONG, 11: "İ\nReleased under the MIT License.",
    }
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], "doc_id long, text string, start string, license string")
    found = collections.defaultdict(list)
    for r in licenses.find(df).collect():
        found[r["doc_id"]].append((r["license"], texts[r["doc_id"]][r["start"] : r["end"]], r["missing"], r["added"]))
    assert {k: sorted(x[0] for x in v) for k, v in found.items()} == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["GPL-2.0"], 4: ["CC-BY-NC-4.0"], 9: ["CC-BY-4.0", "MIT"], 10: ["GPL-3.0"], 11: ["MIT"]}
    assert found[10][0][2:] == ("license", "licence") and found[1][0][1] == "Released under the MIT License"
    assert licenses.find(none).count() == 0
    for n, (name, text) in enumerate(licenses.TEMPLATES.items()):
        assert licenses.ranked([w for w, _, _ in licenses.words(text)], list(range(len(licenses.TEMPLATES))))[0][1] == n, name
    rows = [(None, texts[1]), (None, texts[1]), (2, texts[1])]  # null ids and repeated rows are scanned each by itself
    assert [r["license"] for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == ["MIT"] * 3


def plain_licenses(plain, templates):
    """The closest wordings of all templates among all stretches, closest first, without overlap: (differing words, first, last + 1)."""
    found = []
    for t in templates:
        for a in range(len(plain)):
            for b in range(a + 1, min(len(plain), a + t.reach) + 1):
                part, cost = plain[a:b], {}
                for i in range(len(part) + 1):
                    for k in range(len(t.words) + 1):
                        ways = [0] if i == k == 0 else []
                        if i and k and part[i - 1] == t.words[k - 1]:
                            ways.append(cost[i - 1, k - 1])
                        if i and not licenses._telling(part[i - 1]):
                            ways.append(cost[i - 1, k] + 1)
                        if k and not licenses._telling(t.words[k - 1]):
                            ways.append(cost[i, k - 1] + 1)
                        cost[i, k] = min(ways, default=999)
                if cost[len(part), len(t.words)] <= t.slack:
                    found.append((cost[len(part), len(t.words)], a, b))
    out = []
    for d, a, b in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((d, a, b))
    return sorted(out, key=lambda x: x[1])


def test_every_block_against_every_template(monkeypatch):
    texts = ["MIT", "CC-BY-4.0", "CC-BY-SA-4.0", "Apache-2.0"]
    index = licenses.indexed([licenses.Template(n, licenses.TEMPLATES[n]) for n in texts])
    monkeypatch.setattr(licenses, "_templates", lambda: index)
    rng = random.Random(2)
    for _ in range(25):
        plain = []
        for _ in range(rng.randint(1, 3)):
            part = [w for w, _, _ in licenses.words(licenses.TEMPLATES[rng.choice(texts)])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(part))
                part[k : k + rng.randint(0, 1)] = rng.choice([[], ["word"], ["4.0"], ["mit"]])
            plain += part + [rng.choice(["by", "the", "a", "license"]) for _ in range(rng.randint(0, 4))]
        text = " ".join(plain)
        at = {a: i for i, (_, a, _) in enumerate(licenses.words(text))}
        got = [(len((r[4] + " " + r[5]).split()), at[r[0]]) for r in licenses.scan(text)]
        assert got == [(d, a) for d, a, _ in plain_licenses(plain, index[0])], text


def test_texts_and_headings():
    """Whole licence texts, standard headers and titles; a title counts only as a line of its own."""
    for name, text in licenses.TEXTS:
        assert name in [r[2] for r in licenses.scan(f"code\n{text}\ncode")], name
    assert [r[2] for r in licenses.scan("The MIT License (MIT)\n\nCopyright (c) someone")] == ["MIT"]
    assert licenses.scan("they like the MIT License best") == [] == licenses.scan("mit by 4.0 and gnu " * 5000)


# --- 10 ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
        ("GPL-3.0", "Licensed under the terms of the GNU General Public License, version 3"),
        ("LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1 or later."),
        ("MIT", "Distributed under the terms of the MIT license"),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("CC-BY-3.0", "Licensed under CC BY 3.0."),
        ("CC0-1.0", "Released under CC0 1.0."),
        ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
        ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        ("GPL-2.0-or-later", "// SPDX-License-Identifier: GPL-2.0+"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ],
)
def test_wordings(name, text):
    assert [r[2] for r in licenses.scan(f"prose here and more\n\n\n\n{text}\n\n\n\nother words")] == [name]


def test_notices_in_long_lines():
    rng = random.Random(11)
    for n in (20, 100, 1000, 5000):
        for name in ("MIT", "CC-BY-4.0", "Apache-2.0", "ISC-grant"):
            prose = [f"{rng.choice('bcdfgk')}{rng.choice('aeiou')}{rng.randrange(3000)}x" for _ in range(n)]
            text = " ".join([*prose[: n // 2], licenses.TEMPLATES[name], *prose[n // 2 :]])
            assert [(r[2], r[4], r[5]) for r in licenses.scan(text)] == [(name, "", "")], (n, name)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(7)
    shared, a, b = rng.choice(2**32, (3, 60), replace=False).astype(np.uint32)
    sets = [np.sort(np.r_[shared, x]) for x in (a[:20], b[:30])]
    weights = [rng.integers(1, 5, len(s)).astype(float) for s in sets]
    exact = near_dedup.similarity(sets[0], weights[0], sets[1], weights[1])
    plain = sum(1 / sum(max(dict(zip(sets[0], weights[0])).get(y, 0) / x0, dict(zip(sets[1], weights[1])).get(y, 0) / x1) for y in set(sets[0]) | set(sets[1])) for e in set(sets[0]) & set(sets[1]) for x0, x1 in [(dict(zip(sets[0], weights[0]))[e], dict(zip(sets[1], weights[1]))[e])])
    assert exact == pytest.approx(plain)
    with np.errstate(over="ignore"):
        doc = np.repeat([0, 1], [len(s) for s in sets])
        s = near_dedup.signatures(doc, np.concatenate(sets), np.concatenate(weights), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.random()}"
    return " ".join(words)


def plain_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (set(a) & set(b) and near_dedup.similarity(*[f(s) for s in (a, b) for f in (lambda s: np.array(sorted(hash(x) & 0xFFFFFFFF for x in s), np.uint32), lambda s: np.array([n for _, n in sorted((hash(x) & 0xFFFFFFFF, n) for x, n in s.items())], float))]) >= 0.8):
                up[top(i)] = top(j)
    return [top(k) for k in range(len(rows))]


@pytest.mark.parametrize("chunk", [200_000, 1_000])
def test_near_dedup(spark, odd, none, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)  # the small one takes stars apart and together again
    monkeypatch.setattr(near_dedup, "ANCHORS", 1 if chunk == 1_000 else 8)
    rng = random.Random(9)
    bases = [[f"b{b}w{rng.random()}" for _ in range(120)] for b in range(6)]
    rows = [(d, t) for d, t in ODD if d is not None]
    rows += [(100 + k, edited(rng, bases[k % 6], rng.choice([0, 1, 2, 2, 5]))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("row", "c", "class_id", "near_key", "size", "bands")})
    got = sorted((r["doc_id"], r["class_id"], r["n_docs"]) for r in near_dedup.classes(df).collect())
    label = plain_classes(rows)
    groups = collections.defaultdict(list)
    for k, x in enumerate(label):
        groups[x].append(rows[k][0])
    assert got == sorted((d, min(groups[x]), len(groups[x])) for (d, _), x in zip(rows, label, strict=True))
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({min(g) for g in groups.values()})


def test_pairs_of_exactly_the_threshold_are_linked():
    for union in (15, 60, 80, 100, 120, 200):
        for less in (0, 1):  # one common element fewer is below 0.8
            common, a = union * 4 // 5 - less, union // 10
            first = np.arange(common + a, dtype=np.uint32)
            second = np.r_[np.arange(common), np.arange(common + a, union)].astype(np.uint32)
            found = near_dedup._Sets([first.tobytes(), second.tobytes()], [b"", b""]).near(0, np.ones(2, bool))
            assert found == ([] if less else [1]), union
            weighted = [np.where(np.arange(len(x)) < 0, 1, 2).astype(np.uint32).tobytes() for x in (first, second)]
            assert near_dedup._Sets([first.tobytes(), second.tobytes()], weighted).near(0, np.ones(2, bool)) == found


def test_no_pair_of_near_texts_is_lost(spark):
    """Every link that all-pairs comparison of sf0.01 finds lies inside one class, and no class holds unlinked texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs)).collect()}
    with np.errstate(over="ignore"):
        doc, element, count = near_dedup.shingles(pa.array(docs["text"], pa.string()))
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    sets = near_dedup._Sets([element[i:j].tobytes() for i, j in zip(at, at[1:])], [b"" if count[i:j].max(initial=1) == 1 else count[i:j].astype(np.uint32).tobytes() for i, j in zip(at, at[1:])])
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in range(len(docs)):
        for j in sets.near(k, np.ones(len(docs), bool)):
            up[max(top(k), top(j))] = min(top(k), top(j))
    assert [got[d] for d in docs["doc_id"]] == [docs["doc_id"][top(k)] for k in range(len(docs))]


def test_near_dedup_odd(odd, none, spark):
    assert near_dedup.classes(odd).count() == len(ODD)
    assert near_dedup.one_of_each(clashing(odd)).columns == clashing(odd).columns
    assert near_dedup.classes(none).count() == 0 and near_dedup.one_of_each(none).count() == 0
    nulls = spark.createDataFrame([(None, "same words"), (None, "same  words"), (None, "others")], "doc_id long, text string")
    assert sorted(r["text"].split()[0] for r in near_dedup.one_of_each(nulls).collect()) == ["others", "same"]


# --- queries and pipeline ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    from helpers import of_duck, of_spark

    assert of_spark(queries.QUERIES[name](spark, sf)) == of_duck(duck, queries.ORACLE_SQL[name])


def test_query_columns(spark, sf):
    cols = {
        "op1_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op4_exact_top_k": "query_id rank vec_id score",
        "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_grams ratio", "op9_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    }
    for name, want in cols.items():
        assert queries.QUERIES[name](spark, sf).columns == want.split(), name
    r = queries.op6_pii(spark, sf).where("n_card > 0").first()
    assert len(r["base_sha256"]) == 64 and "card:" in r["spans"]
    d = queries.op2_byte_bpe(spark, sf).orderBy("doc_id").first()
    t = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first()["text"]
    assert d["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def plain_kept(rows, weights):
    """Ids of the documents that the quality rules keep, from plain counts and the table of bucket weights."""
    kept = set()
    for d, t in rows:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t or "") if x]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeats = len({k + x for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for x in range(3)})
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in w]
        h += [xxhash.xxh64_intdigest(b.encode(), seed=a) for a, b in zip(list(h), w[1:])]
        total = sum(int(weights[x % quality.BUCKETS]) for x in h)  # a power of two, so the sign of the hash doesn't matter
        if len(w) >= 50 and 100 * repeats <= 50 * len(w) and total >= math.floor(quality.THRESHOLD * quality.SCALE) * len(h):
            kept.add(d)
    return kept


def test_pipeline(spark, sf, odd):
    """Every stage's rows, from those of the one before, against plain versions; odd rows pass every stage."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    weights = quality.ratios(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for name, stage in p.STAGES[:-1]:
        docs = p.common.keep(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "quality_rules":
            kept = plain_kept(rows, weights)
            rows = [x for x in rows if x[0] in kept]
        elif name == "line_dedup":
            texts = dict(plain_line_dedup(rows))
            rows = [(d, texts[repr(d)]) for d, _ in rows]
        elif name == "near_dedup":
            label = plain_classes(rows)
            least = {x: min(d for (d, _), y in zip(rows, label) if y == x) for x in set(label)}
            rows = [x for x in rows if x[0] in least.values()]
        else:
            rows = [(d, pii.mask_text(t, pii.train())) for d, t in rows]
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows), name
    full, want = word_tokens.load(WORDS).full, []
    for d, t in rows:
        ids = [*full.encode(t, add_special_tokens=False).ids, 0]
        want += [(d, k, 2048 * k, len(x := ids[2048 * k : 2048 * k + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
    packed = p.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    fill = collections.Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 1
    shapes = []
    for rows in (odd, odd.limit(0), clashing(odd)):
        for _, stage in p.STAGES:
            shapes.append(stage(spark, rows, sf).count())
    assert shapes[1:4] == [len(ODD), len(ODD) - 4, len(ODD)] and shapes[4] > len(ODD) and shapes[5:10] == [0] * 5 and shapes[10:] == shapes[:5]


def test_line_dedup_takes_a_batch_in_pieces(spark):
    """Python's memory follows a piece of a batch, not the whole: 3,000 texts of 6 KB in one task take less than their own size again and again."""
    import tracemalloc

    texts = [f"{k} " + "x" * 6000 for k in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    del texts
    tracemalloc.start()
    rows = sum(len(b) for b in line_dedup._pairs(20)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 15_000_000


def test_sketches_take_a_batch_in_pieces(monkeypatch):
    """2,000 texts of 1,000 words in one batch: what is made of them at once doesn't grow with the batch, and pieces don't change a row."""
    import tracemalloc
    import types

    monkeypatch.setattr(near_dedup, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(2000)] + ["", None, "one two"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    out = pa.Table.from_batches(near_dedup._sketch([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
    monkeypatch.setattr(near_dedup, "PIECE", 2**40)
    whole = pa.Table.from_batches(near_dedup._sketch([batch.slice(1900)]))
    assert out["row"].to_pylist() == [(3 << 40) + k for k in range(len(texts))] and out.slice(1900).drop(["row"]).combine_chunks().equals(whole.drop(["row"]).combine_chunks())


def test_one_of_each_needs_no_text_where_ids_differ(spark, sf, monkeypatch):
    """Of rows with an id of their own no content is looked at again; batches of sketches are small, and the session's setting is as before."""
    before, seen = spark.conf.get(common.BATCH_ROWS), []
    run = near_dedup.common.keep
    monkeypatch.setattr(near_dedup.common, "keep", lambda df, label="t", rows=None: (seen.append(rows) if label == "near-sketches" else None, run(df, label, rows))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = near_dedup.one_of_each(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Aggregate" not in plan
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    want = sorted(repr(r) for r in docs.collect() if classes[r["doc_id"]] == r["doc_id"])
    assert sorted(map(repr, kept.collect())) == want and 0 < len(want) < len(classes)
    assert seen == [1000, 1000] and spark.conf.get(common.BATCH_ROWS) == before
    rows = docs.limit(50).collect()
    more = [*rows, rows[0], (rows[1][0], "another text altogether of seven words", *rows[1][2:]), (None, rows[2][1], *rows[2][2:]), (None, "no id and a text of its own", *rows[2][2:]), (None, "no id  and a text of its OWN", *rows[2][2:])]
    got = near_dedup.one_of_each(spark.createDataFrame(more, docs.schema)).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    assert ids[None] == 1 and ids[rows[0][0]] == 1 and max(ids.values()) == 1


def test_language_model_looks_up_distinct_cells():
    """Spellings look up each distinct cell once, with the values that a look-up of every byte gives."""
    rng = np.random.default_rng(6)
    words = pa.array([bytes(rng.integers(97, 103, n).tolist()) for n in rng.integers(0, 12, 5000)] + [b"\xff\x00", b"z" * 300], pa.large_binary())
    cells, n = language_model.spell(words)
    some = np.unique(cells[:20_000])
    speller, asked = language_model.Speller(some, rng.integers(1, 50, len(some)), rng), []
    want = np.add.reduceat(speller.log_prob(cells), np.cumsum(n) - n)
    whole = speller.log_prob
    speller.log_prob = lambda c: (asked.append(len(c)), whole(c))[1]
    assert np.array_equal(language_model.log_spelling(speller, words), want) and asked == [len(np.unique(cells))] and len(language_model.log_spelling(speller, words[:0])) == 0


def test_line_dedup_pieces_keep_rows_apart(spark, monkeypatch):
    """Texts larger than a piece, null ones and several pieces a batch: every row gets its own text."""
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"only of document number {k}\n" + "shared by every document here\n" + "y" * (3_000_000 if k % 9 == 0 else 10), k * 10) for k in range(1, 40)], "doc_id long, text string, other long").coalesce(1)
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).select("doc_id", "other", "n_lines", "n_dropped", F.substring("text", 1, 30).alias("start"), F.length("text").alias("n")).collect()}
    holders = [k for k in range(1, 40) if k % 7]
    for k in range(1, 40):
        r = got[k]
        assert r["other"] == k * 10
        if k % 7 == 0:
            assert (r["start"], r["n_lines"], r["n_dropped"]) == (None, 1, 0)
        else:
            assert r["start"].split("\n")[0] == f"only of document number {k}" and (r["n_lines"], r["n_dropped"]) == (3, int(k != max(holders)) + int(k % 9 == 0 and k != max(h for h in holders if h % 9 == 0)))
