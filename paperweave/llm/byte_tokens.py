"""Byte-level BPE ids of whole texts, as the public library gives them, with a cache over white-space units.

A blank between two characters that are not white space always begins a new piece of the tokenizer's pattern, so texts can
be cut there, and the ids of each unit are looked up. Units that only the full library treats rightly (special tokens,
letters beyond Latin, whose Unicode tables differ between libraries) go to it; the others to the faster rank encoder with the same vocabulary.

Defined cases: null or empty text has no ids; a very long text is cut at blanks and a unit without blanks goes to the encoder
whole; equal texts have equal ids; columns and tables are the callers' matter.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

from .bpe import LONG_UNIT, Recent, byte_letters
from .wordhash import give_back

#: Fixed value: the piece pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LIBRARY = re.compile("[^\x00-ɏ]|<\\|")


UNITS = 80_000


class ByteTokens:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        del spec, byte_of, ranks
        give_back()  # what reading the vocabulary took
        self.units = Recent(UNITS)  # smaller than that of the other encoder: a worker keeps it while it runs other stages

    def forget(self) -> None:
        """Empty the cache."""
        self.units = Recent(UNITS)

    def _ids(self, text: str) -> bytes:
        if _LIBRARY.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    @staticmethod
    def _cut(text: str) -> list[str]:
        if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
            return _CUT.split(text)
        return text.split(" ")

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        first, *rest = self._cut(text)
        units, ids = self.units, self._ids
        young = units.young
        new = units.missing(set(rest))
        for u in new:
            young[u] = ids(" " + u)
        out = ids(first) + b"".join(map(young.__getitem__, rest))
        for u in new:
            if len(u) > LONG_UNIT:
                del young[u]
        units.age()
        return out


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)
