"""Byte-level BPE (2): a sentencepiece BPE model written out from a rank file.

Each rank's bytes become a piece (one character per byte), scored by its negative rank, under identity
normalisation; so sentencepiece, which joins the best-scored neighbours first and the
leftmost of equals, joins as the rank file says. Texts are split into pre-tokens, each encoded by itself;
ids are ranks. Decoding maps ids back to bytes.

Null text counts as empty: no ids. Text is encoded as UTF-8 whatever its length; nothing is cut.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept at most per worker and cache: the first ones seen, which the frequent ones are among.
CACHE = 200_000


def byte_chars() -> list[str]:
    """A character for each byte: itself where sentencepiece treats it as any other, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


# --- the model file -------------------------------------------------------


def _varint(n: int) -> bytes:
    out = b""
    n &= 2**64 - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: field 1 pieces, 2 trainer settings, 3 normaliser settings."""
    chars = byte_chars()
    out = []
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in raw).encode()) + _field(2, float(-rank))))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))  # type 2: unknown
    bpe, unknown, none = _field(3, 2), _field(40, len(ranks)), b"".join(_field(k, -1) for k in (41, 42, 43))
    out.append(_field(2, bpe + _field(4, len(ranks) + 1) + unknown + none))
    out.append(_field(3, _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))))  # no dummy prefix, no space removal or escape
    return b"".join(out)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.chars = byte_chars()
        self.to_chars = dict(enumerate(self.chars))
        self.raw = pa.array([k for k, _ in sorted(self.ranks.items(), key=lambda x: x[1])], pa.large_binary())
        self.tokens: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def token(self, s: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit numbers."""
        x = self.tokens.get(s)
        if x is None:
            raw = s.encode()
            ids = [self.ranks[raw]] if raw in self.ranks else self.model.encode(raw.decode("latin-1").translate(self.to_chars))
            x = b"".join(i.to_bytes(4, "little") for i in ids)
            if len(self.tokens) < CACHE:
                self.tokens[s] = x
        return x

    def _word(self, cache: dict, word: str, lead: str) -> bytes | None:
        """A word between single spaces; None if white space at its edge ties it to its neighbours."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        x = b"".join(map(self.token, self.split(lead + word)))
        if len(cache) < CACHE:
            cache[word] = x
        return x

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        The pattern always breaks before a single space or line feed that stands between other
        characters, so words between those can be encoded one by one and kept. A text in which
        white space comes in runs or at the ends is split by the pattern as a whole.
        """
        out, feed = [], self.token("\n")
        first, later = self.first, self.later
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
            words = iter(line.split(" "))
            w = next(words)
            x = first.get(w) or self._word(first, w, "")
            if x is None:
                return b"".join(map(self.token, self.split(text)))
            out.append(x)
            for w in words:
                x = later.get(w) or self._word(later, w, " ")
                if x is None:
                    return b"".join(map(self.token, self.split(text)))
                out.append(x)
        return b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        parts = [self.encode(t) if t else b"" for t in texts]
        offsets = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))]))

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_batch(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids: the tokens' bytes one after the other, cut where lists end."""
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        tokens = self.raw.take(flat)  # an id that isn't a rank is an error
        cuts = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts[np.r_[0, ends].astype(np.int64)].tobytes()), tokens.buffers()[2]])
        return texts.cast(pa.binary())


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _small(batches, rows: int = 512):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _encoded(path: str, pattern: str):
    def run(batches):
        bpe = load(path, pattern)
        for b in _small(batches):
            yield pa.record_batch([b.column(0), bpe.encode_batch(b.column(1).to_pylist())], ["doc_id", "ids"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches):
        bpe = load(path, pattern)
        for b in _small(batches):
            yield pa.record_batch([b.column(0), b.column(1), bpe.decode_batch(b.column(1))], ["doc_id", "ids", "decoded"])

    return run


IDS, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded binary"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids``: every text's ids, empty for null or empty text."""
    return _texts(docs).mapInArrow(_encoded(path, pattern), IDS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (bytes); null ids decode to no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``decode`` makes of what ``encode`` returns, in one Python worker a task instead of two, each with a model and caches."""
    there, back = _encoded(path, pattern), _decoded(path, pattern)
    return _texts(docs).mapInArrow(lambda batches: back(there(batches)), DECODED)
