"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the true merge result exactly when every token merges to
itself and no two neighbours are incompatible: at no time of the merge order does a merge across their border come first.
The border tests of all words of a batch run together in numpy; only words that fail are merged exactly.

White-space units are kept as long as they are in use, so the work per word of running text is one dictionary look-up.

Defined cases: null or empty text has no ids and decodes to the empty string; a very long text is one batch of its own, and a
long word is merged over a heap, so that its cost stays near linear; there are no ties, as merge ranks are distinct; repeated
rows and null ids are encoded alike; other columns than the id and the text are dropped, whatever their names; an empty table
gives an empty result; special tokens inside a text become their ids, as the public library does it.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .wordhash import batches

NEVER = np.int64(1 << 40)
NO_RANK, SHORT_WORD = 1 << 40, 40
#: Entries of one generation of a worker's caches.
UNITS, WORDS = 400_000, 150_000
#: Units longer than this are encoded each time and not kept.
LONG_UNIT = 64
#: str.split() also splits at these, which are no white space in the tokenizers' patterns.
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_BEYOND = re.compile("[^\x00-\u024f]")


class Recent:
    """A bounded cache: a young and an old generation of about `size` entries each. What is still in use moves from the old one to the young one before the old one goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Those keys that are in neither generation; the others are in the young one from now on."""
        gone = []
        for k in keys.difference(self.young):
            if (found := self.old.get(k)) is None:
                gone.append(k)
            else:
                self.young[k] = found
        return gone

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies: itself where printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Vocabulary, merge order and border tables of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = np.full(size, "", object)
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = text
        self.letters = byte_letters()
        #: Every beginning of a token that can stand inside a word: its id, or -1 where it is no token itself.
        self.steps: dict[str, int] = {}
        inner = [x for x in self.vocab.items() if not self.end or not x[0].endswith(self.end)]
        for text, _ in inner:
            self.steps.update((text[:k], -1) for k in range(1, len(text)))
        self.steps.update(inner)
        self.ending = max(map(len, self.vocab)) - len(self.end)
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._tables(model["merges"], size)

    def _tables(self, merges: list, size: int) -> None:
        self.size = size
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_by: list[int] = []  # by rank
        made = np.full(size, NEVER, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        twice = np.zeros(size, bool)
        for r, pair in enumerate(merges):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.vocab[x], self.vocab[y], self.vocab[x + y]
            self.made_by.append(c)
            if (a, b) in self.rank:
                continue
            self.rank[a, b] = (r, c)
            if left[c] >= 0:
                twice[c] = True
            else:
                left[c], right[c], made[c] = a, b, r
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.right_edge, self.right_until = self._edge(right, made)
        self.left_edge, self.left_until = self._edge(left, made)
        inner = np.flatnonzero(left >= 0)
        border = self.compatible(left[inner], right[inner], made[inner])
        self.whole = ~twice  # tokens that merge to themselves
        for c, ok in sorted(zip(inner.tolist(), border.tolist(), strict=True), key=lambda x: made[x[0]]):
            self.whole[c] &= ok and self.whole[left[c]] and self.whole[right[c]]

    @staticmethod
    def _edge(child: np.ndarray, made: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Level by level, the token at the edge of each token, and the rank at which it is merged into the one above."""
        tokens, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while (below := np.where(tokens[-1] >= 0, child[tokens[-1]], -1)).max() >= 0:
            until.append(np.where(below >= 0, made[tokens[-1]], NEVER))
            tokens.append(below)
        return tokens, until

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For pairs of neighbouring tokens: true where no merge across the border precedes those that make a and b. limit: rank at which both end."""
        ok = np.ones(len(a), bool)
        for i, (x_of, x_until) in enumerate(zip(self.right_edge, self.right_until, strict=True)):
            rows = np.flatnonzero(ok & (x_of[a] >= 0))
            if not len(rows):
                break
            for j, (y_of, y_until) in enumerate(zip(self.left_edge, self.left_until, strict=True)):
                rows = rows[y_of[b[rows]] >= 0]
                if not len(rows):
                    break
                key = x_of[a[rows]] * self.size + y_of[b[rows]]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                m = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
                x_end = limit[rows] if limit is not None and i == 0 else x_until[a[rows]]
                y_end = limit[rows] if limit is not None and j == 0 else y_until[b[rows]]
                # Of two merges of one rank the left one comes first.
                bad = (m < x_end) & (m <= y_end) & (m < NEVER)
                ok[rows[bad]] = False
                rows = rows[~bad]
        return ok

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left; None where some letter is unknown."""
        out, at, n, steps = [], 0, len(word), self.steps.get
        while at < n:
            if n - at <= self.ending and (found := self.vocab.get(word[at:] + self.end)) is not None:
                out.append(found)
                return out
            best, stop, end = -1, at, at + 1
            while end <= n and (found := steps(word[at:end])) is not None:
                if found >= 0:
                    best, stop = found, end
                end += 1
            if stop == n and self.end:  # the whole rest, but not as the end of a word
                best, stop = self._inner(word, at, n)
            if best < 0:
                return None
            out.append(best)
            at = stop
        return out

    def _inner(self, word: str, at: int, n: int) -> tuple[int, int]:
        for end in range(n - 1, at, -1):
            if (found := self.steps.get(word[at:end], -1)) >= 0:
                return found, end
        return -1, at

    def exact(self, word: str) -> list[int]:
        """Merge by rank, leftmost first. Letters without an id are left out."""
        symbols = [*word[:-1], word[-1] + self.end]
        ids = [i for s in symbols if (i := self.vocab.get(s)) is not None]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Search the whole word for the lowest rank each time."""
        found, none = self.rank.get, (NO_RANK, -1)
        ranks = [found(p, none)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < NO_RANK:
            i = ranks.index(low)
            ids[i] = new = self.made_by[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = found((ids[i - 1], new), none)[0]
            if i < len(ranks):
                ranks[i] = found((new, ids[i + 1]), none)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """With a heap over a linked list, so that the cost stays near linear."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, new, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.rank.get((ids[i], ids[j])) != (r, new):
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if found := self.rank.get((new, ids[after[j]])):
                    heapq.heappush(heap, (*found, i))
            if before[i] >= 0 and (found := self.rank.get((ids[before[i]], new))):
                heapq.heappush(heap, (*found, before[i]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The method: propose all, test all borders at once, merge the failing ones exactly."""
        proposed = [self.greedy(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed if p for t in p), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        bad = np.array([p is None for p in proposed], bool)
        bad[of[~self.whole[flat]]] = True
        pair = np.flatnonzero(of[1:] == of[:-1])
        keys, back = np.unique(flat[pair] * self.size + flat[pair + 1], return_inverse=True)
        ok = self.compatible(keys // self.size, keys % self.size)[back] if len(keys) else np.ones(0, bool)
        bad[of[pair[~ok]]] = True
        for i in np.flatnonzero(bad):
            proposed[i] = self.exact(words[i])
        return proposed


class Encoder:
    """Whole texts to ids. One per worker and tokenizer file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.units, self.words = Recent(UNITS), Recent(WORDS)
        # Only their normaliser and splitter, for letters beyond Latin: Unicode tables differ between libraries.
        public = Tokenizer.from_file(path)
        self.normalise, self.split = public.normalizer.normalize_str, public.pre_tokenizer.pre_tokenize_str

    def _words(self, unit: str) -> list[str]:
        m = self.merges
        if unit.isascii():
            text = unit.lower()
            if text.isalpha():
                return [text]
            found = m.pattern.findall(text)  # of the ASCII bytes only control characters have another letter
            return found if text.isprintable() else ["".join([m.letters[b] for b in w.encode()]) for w in found]
        if _BEYOND.search(unit):
            return [w for w, _ in self.split(self.normalise(unit))]
        text = "".join([c.lower() for c in unicodedata.normalize("NFC", unit)])
        return [w if w.isascii() and w.isprintable() else "".join([m.letters[b] for b in w.encode()]) for w in m.pattern.findall(text)]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """ids, as little-endian 32-bit numbers, of units not seen before."""
        m, parts, words = self.merges, [], self.words
        for unit in units:
            if m.split_special and "<|" in unit and m.split_special.search(unit):
                parts.append([w for x in m.split_special.split(unit) if x for w in ([m.special[x]] if x in m.special else self._words(x))])
            else:
                parts.append(self._words(unit))
        new = words.missing({w for p in parts for w in p if isinstance(w, str)})
        words.young.update((w, array("i", ids).tobytes()) for w, ids in zip(new, m.encode_words(new), strict=True))
        known = words.young
        out = {u: known[p[0]] if len(p) == 1 and isinstance(p[0], str) else b"".join([known[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in p]) for u, p in zip(units, parts, strict=True)}
        for w in new:
            if len(w) > LONG_UNIT:
                del known[w]
        words.age()
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids, one after another."""
        split = [[] if not x else [u for u in _SPACES.split(x) if u] if _ODD.search(x) else x.split() for x in texts]
        units = self.units
        if new := units.missing(set(chain.from_iterable(split))):
            units.young.update(self._learn(new))
        each = [b"".join(map(units.young.__getitem__, x)) for x in split]
        for u in new:
            if len(u) > LONG_UNIT:
                del units.young[u]
        units.age()
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in each])]).astype(np.int32)
        return offsets, np.frombuffer(b"".join(each), "<i4")

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Like the public library's decode without a decoder: the tokens' strings, joined by one blank."""
        strings = self.merges.strings[ids]
        return [" ".join(strings[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str, decode: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        gc.disable()  # nothing here makes cycles, and each collection would walk through the caches
        for batch in batches(it, 1000):
            offsets, ids = enc.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
            if decode:
                columns.append(pa.array(enc.decode(offsets, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
        gc.enable()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(path, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encoding, and the decoding of those ids, in one pass."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(path, True), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); null ids decode to the empty string."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches(it, 1000):
            rows = [x or [] for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            ids = np.fromiter((i for x in rows for i in x), np.int64, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.decode(offsets, ids), pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")
