"""Ids of the word-end BPE file, by a word cache.

White space separates words for that tokenizer and none of its rules looks across it,
so a text's ids are its words' ids in a row. Words that aren't cached go to the
``tokenizers`` library, or, if all their characters lie below U+0250 (where case and
composition are plain), to the same merges run by ``tiktoken``: the file's ids are in
merge order, so ranks are ids, and one marker byte stands for the word end.
"""

from __future__ import annotations

import functools
import json
import os

#: Words kept at most per worker: the first ones seen, which the frequent ones are among.
CACHE = 200_000
MARK = "\x01"
#: Not plain for case, composition or white space although below U+0250.
ODD = frozenset("\x01\x85\xa0İ\x1c\x1d\x1e\x1f")


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE files: a byte's own character if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars, special = _byte_chars(), {t["content"] for t in model["added_tokens"]}
        ranks = {}
        for piece, i in model["model"]["vocab"].items():
            if piece not in special:
                end = piece.endswith("</w>") and piece != "</w>"
                ranks[bytes(chars[c] for c in (piece[:-4] if end else piece)) + MARK.encode() * end] = i
        self.merges = tiktoken.Encoding("word-ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, word: str) -> list[int]:
        if max(word) < "ɐ" and ODD.isdisjoint(word):
            word = word.lower()
            if word.isalpha():
                return self.merges.encode_ordinary(word + MARK)
            return [i for p in self.parts(word) for i in self.merges.encode_ordinary(p + MARK)]
        return self.full.encode(word, add_special_tokens=False).ids

    def encode(self, text: bytes) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        cache = self.cache
        words = text.lower().split()
        out = list(map(cache.get, words))
        if None in out:
            for k, (w, x) in enumerate(zip(words, out, strict=True)):
                if x is None:
                    if (x := cache.get(w)) is None:
                        x = b"".join(i.to_bytes(4, "little") for i in self._ids(w.decode()))
                        if len(cache) < CACHE:
                            cache[w] = x
                    out[k] = x
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    """One per worker process."""
    return WordTokens(path)
