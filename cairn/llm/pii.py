"""Personal data (6): fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns' spans always stay. Around every digit or at-sign the text is cut into tokens; segments
of up to ``LONGEST`` tokens are scored as wholes (digit groups, separators, check digits, what stands beside
them), and a dynamic program over all segmentations chooses boundaries and kinds together. A chosen
segment counts if no pattern's span touches it and the model's odds for it are at least
``ODDS`` against the same place left blank.

The model is trained here, by likelihood over all segmentations, on windows written from seeded templates
(``examples``); nothing of the corpus is needed, so an empty table works too. Null text counts as empty and
has no spans; masking keeps it null. Ids aren't looked at, so null or repeated ids are fine. Very long texts
take time in proportion to their length.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment, at most.
LONGEST = 20
#: Characters of a window on both sides of a trigger, at least; it goes on to where the next white space follows.
REACH = 48
#: Segments whose scores are held at once.
HELD = 100_000
#: Log odds that an added segment needs.
ODDS = 1.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


# --- the model ------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around triggers; windows that touch are one. None begins or ends inside a run of characters without white space
    that reaches its trigger, and a segment has at most ``LONGEST`` tokens, so what the field can choose lies whole in a window."""
    found = []
    for m in _TRIGGER.finditer(text):
        if found and m.start() <= found[-1][1]:
            if m.end() + REACH <= found[-1][1]:
                continue
        else:
            found.append([_back(text, max(0, m.start() - REACH)), 0])
        end = _SPACE.search(text, min(len(text), m.end() + REACH))
        found[-1][1] = end.start() if end else len(text)
    return [[t.span() for t in _TOKEN.finditer(text, a, b)] for a, b in found]


_SPACE = re.compile(r"\s")


def _back(text: str, at: int) -> int:
    while at and not text[at - 1].isspace():
        at -= 1
    return at


def features(text: str, a: int, b: int) -> list[str]:
    """Of a whole candidate segment, the same for all kinds."""
    s = text[a:b]
    digits = "".join(_DIGIT.findall(s))
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    out = ["any", f"digits {min(len(digits), 20)}", "groups " + "-".join(str(len(g)) for g in groups[:6])]
    out.append("marks " + re.sub(r"[^\W_]+", "", s)[:10])
    out.append("letters" if re.search(r"[^\W\d_]", s) else "no letters")
    if 14 <= len(digits) <= 19 and luhn(digits):
        out.append("check digit")
    if len(groups) == 4:
        out.append("four bytes" if all(map(_small, groups)) else "four numbers")
    if re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[({]at[\])}])\s?[\w-]+(?:\s?(?:\.|[\[({]dot[\])}])\s?[\w-]+)+", s):
        out.append("address")
        edges = (not before or not (before.isalnum() or before in "._%+-")), not after or not (after.isalnum() or after == "-")
        out.append(f"address {edges}")
        if "@" not in s:
            out.append(f"loose address {edges}")
    out.append("left " + ("edge" if not before or before.isspace() else "word" if before.isalnum() else "mark"))
    out.append("right " + ("edge" if not after or after.isspace() else "word" if after.isalnum() else "mark"))
    if "\n" in s:
        out.append("break")
    return out


def reaching(text: str, tokens: list[tuple[int, int]]) -> Iterator[list[int]]:
    """For each token the ends (last + 1) of the candidate segments that begin there: they hold seven digits, or a digit group and three dots, or an at-sign."""
    for i, (a, _) in enumerate(tokens):
        out: list[int] = []
        digits = dots = at = 0
        for j in range(i, min(i + LONGEST, len(tokens))) if text[a].isalnum() or text[a] in "+(" else ():
            x, y = tokens[j]
            c = text[x]
            if j > i and (gap := x - tokens[j - 1][1]):  # words apart don't join but beside brackets
                last = text[tokens[j - 1][0]]
                if gap > 1 or (c.isalpha() or last.isalpha()) and not (c in "[({" or last in "])}"):
                    break
            digits += (y - x) * ("0" <= c <= "9")
            dots += c == "."
            at += c == "@" or text[x:y] == "at"
            if c.isalnum() and (digits >= 7 or at or (dots == 3 and digits)):
                out.append(j + 1)
        yield out


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All candidate (first, last + 1) tokens."""
    return [(i, j) for i, ends in enumerate(reaching(text, tokens)) for j in ends]


class Model:
    """Weights of (kind, feature); unknown features weigh nothing. Blank tokens score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.known: dict[tuple[str, str, str], tuple[int, float]] = {}

    def score(self, text: str, a: int, b: int) -> tuple[int, float]:
        """The best kind of a segment and its score; the same for the same characters in it and beside it."""
        key = text[max(0, a - 1) : a], text[a:b], text[b : b + 1]
        if key not in self.known:
            if len(self.known) >= HELD:
                self.known.clear()
            total = np.zeros(len(KINDS))
            for f in features(text, a, b):
                if (w := self.weights.get(f)) is not None:
                    total += w
            self.known[key] = int(total.argmax()), float(total.max())
        return self.known[key]

    def best(self, text: str, tokens: list, least: float = ODDS) -> list[tuple[int, int, int]]:
        """Those segments of the most likely segmentation that score ``least``."""
        top, back = [0.0] + [-math.inf] * len(tokens), [None] * (len(tokens) + 1)
        for t, ends in enumerate(reaching(text, tokens)):
            if top[t] > top[t + 1]:
                top[t + 1], back[t + 1] = top[t], None
            for j in ends:
                k, s = self.score(text, tokens[t][0], tokens[j - 1][1])
                if s > 0 and top[t] + s > top[j]:
                    top[j], back[j] = top[t] + s, (t, k, s)
        out, t = [], len(tokens)
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, k, s = back[t]
                if s >= least:
                    out.append((tokens[i][0], tokens[t - 1][1], k))
                t = i
        return out[::-1]


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows from templates: the four kinds in usual and loose writing, and look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 9)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(r.choice((14, 15, 16, 16, 16, 19)) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def email() -> str:
        at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")))
        local = r.choice((word(), f"{word()}.{number(2)}", f"{word()}.{word()}", f"{word()}_{number(3)}"))
        return re.sub("é", "e", local + at + dot.join([word() + r.choice(("", number(1))), *[word()] * r.randint(0, 1), r.choice(("com", "org", "net", "de"))]))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(1)}.{a}.{b}.{c}"))

    def none() -> str:
        bad = number(16)
        bad = bad[:-1] + next(c for c in "0123456789" if not luhn(bad[:-1] + c))
        return r.choice((number(r.randint(1, 6)), f"{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", bad, number(r.randint(7, 13)), number(r.randint(20, 30)),
                         f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"{r.randint(256, 999)}.{number(3)}.{number(3)}.{number(2)}", f"{number(3)} {number(3)} {number(3)} {number(4)} {number(2)}",
                         f"v{number(1)}.{number(2)}.{number(1)}", f"{number(3)},{number(3)},{number(3)}", f"@{word()}", f"{word()}@{word()}", f"{number(2)}:{number(2)}:{number(2)}.{number(3)}", f"{number(2)}/{number(2)}/{number(4)}"))

    kinds = (email, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone)
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(3)), []
        for _ in range(r.choice((1, 1, 2))):
            text += r.choice((" ", " ", "\n", ", "))
            k = r.randint(0, 7)
            s = kinds[k]() if k < 4 else none()
            if k < 4:
                spans.append((len(text), len(text) + len(s), k))
            text += s + r.choice((" ", " ", ".", ", ")) + word()
        out.append((text + " " + word(), spans))
    return out


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


@functools.lru_cache(maxsize=1)
def train(n: int = 900, rounds: int = 25, seed: int = 7) -> Model:
    """Stochastic gradient ascent (AdaGrad) on the likelihood of the labelled segmentations against all."""
    cases = []
    for text, spans in examples(n, seed):
        for tokens in windows(text):
            place = {a: i for i, (a, _) in enumerate(tokens)} | {-b: i + 1 for i, (_, b) in enumerate(tokens)}
            gold = {(place[a], place[-b]): k for a, b, k in spans if a in place and -b in place}
            found = segments(text, tokens)
            cases.append((len(tokens), found, [features(text, tokens[i][0], tokens[j - 1][1]) for i, j in found], gold))
    names = {f: k for k, f in enumerate(sorted({f for *_, fs, _ in cases for x in fs for f in x}))}
    w, g2 = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
    cases = [(n, found, [np.array([names[f] for f in x]) for x in fs], gold) for n, found, fs, gold in cases]
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(cases)
        for n, found, fs, gold in cases:
            if not found:
                continue
            scores = [w[x].sum(axis=0) for x in fs]
            ends, starts = {}, {}
            for m, (i, j) in enumerate(found):
                ends.setdefault(j, []).append((i, m))
                starts.setdefault(i, []).append((j, m))
            mass = [_log_sum(s.tolist()) for s in scores]
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for t in range(1, n + 1):
                forward[t] = _log_sum([forward[t - 1], *(forward[i] + mass[m] for i, m in ends.get(t, ()))])
            for t in range(n - 1, -1, -1):
                backward[t] = _log_sum([backward[t + 1], *(backward[j] + mass[m] for j, m in starts.get(t, ()))])
            step = np.zeros_like(w)
            for m, (i, j) in enumerate(found):
                push = -np.exp(scores[m] + forward[i] + backward[j] - forward[n])
                if (i, j) in gold:
                    push[gold[i, j]] += 1
                if np.abs(push).max() > 1e-3:
                    step[fs[m]] += push
            step -= 1e-4 * w
            g2 += step * step
            w += 0.3 * step / np.sqrt(g2)
    return Model({f: w[k] for f, k in names.items()})


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and all spans."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = np.array([(a, b) for a, b, _ in base]).reshape(-1, 2)
    more = [(a, b, k) for tokens in windows(text) for a, b, k in model.best(text, tokens) if not ((taken[:, 0] < b) & (taken[:, 1] > a)).any()]
    return base, sorted({*base, *more}, key=lambda x: (x[0], x[2], x[1]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id``; ``base``: the patterns' spans and ``spans``: all spans, each as kind:start:end (code points) joined by commas."""
    model = train()

    def run(batches):
        for pdf in batches:
            found = [find(t or "", model) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": [listed(b) for b, _ in found], "spans": [listed(s) for _, s in found]})

    # nullable ids must not turn to floats on the way through pandas
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInPandas(run, "doc_id string, base string, spans string").withColumn("doc_id", F.col("doc_id").cast("long"))


def mask_text(text: str, model: Model) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, k in find(text, model)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; other columns (n_chars too) stay as they are."""
    model = train()

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask_text(t, model) for t in text], dtype=object)

    return docs.withColumn("text", masked(F.col("text").cast("string")))
