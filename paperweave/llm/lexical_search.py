"""Ranked lexical search by hashed max-sketches.

The impact of a term in a document grows with its count there and falls with the document's length; the score of a document for
an item sums weight times impact over the item's terms. Search takes three passes over an index that is written once:

1. the index keeps, for each document, its length and its distinct terms (64-bit hashes, sorted) with their counts;
2. the documents that hold each asked term are counted, over all documents; that and the totals give the weights;
3. each task folds the impacts of a document into a sketch of SKETCH coordinates, each the largest impact of the terms that hash
   to it. One matrix product of sketches and weights gives an upper bound for every document and item of a batch. Per item,
   documents are then scored exactly in descending order of their bounds, until the bound falls below the score of the tenth best.

Each task keeps the best of its own documents, so an item sends `limit` rows a task at most; ranks come from those. Items are taken
in blocks of about BLOCK_ITEMS items and BLOCK_TERMS terms, so what is sent to the tasks has a fixed size.

Terms are compared by a 64-bit hash: among 10^9 words and 10^4 asked terms, two are taken for one with a probability of 5e-7.

Defined cases: null text has no terms and counts for nothing; a very long text is read whole; each row is a document of its own,
so a repeated row can be found twice, with ranks of its own; null document ids come last among equal scores; rows of
one item id, null ids too, are one item with the terms of all of them; an item without terms, or whose terms are in no document, has
no rows; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .wordhash import U64, Texts, batches, hashes

LIMIT = 10
#: Coordinates of a sketch: the first bits of a term's hash.
SKETCH_BITS = 13
SKETCH = 1 << SKETCH_BITS
BLOCK_ITEMS, BLOCK_TERMS = 256, 50_000
#: Documents whose sketches are held at once, and documents scored exactly at once.
SEARCHED, CHUNK = 1000, 32
#: What the bounds are raised by, so that single precision cannot lower one.
SLACK = 1.0005
INDEX = "doc_id long, n long, terms binary, counts binary"

#: Everything in ASCII but letters and digits parts two terms.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = False


def _counted(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and text, hash and count of each distinct term, by text and hash."""
    data = texts.lower_ascii()
    start, end, doc = texts.spans(BREAK)
    h = hashes(data, start, end)
    by_hash = np.argsort(h)
    by_doc = by_hash[np.argsort(doc[by_hash].astype(np.uint16), kind="stable")]  # at most 2000 texts a batch
    h, doc = h[by_doc], doc[by_doc]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return np.bincount(doc, minlength=texts.n), doc[new], h[new], np.diff(np.append(new, len(h)))


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each stretch of values between two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _index_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        n, doc, h, tf = _counted(Texts(batch.column(1)))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _binary(h, cuts), _binary(tf.astype(np.uint32), cuts)], names=["doc_id", "n", "terms", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs, a written table that any number of searches can use."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(texts.mapInArrow(_index_rows, INDEX), "index")


def _asked_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        _, doc, h, _ = _counted(Texts(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(h.view(np.int64))], names=["item_id", "term"])


@dataclass
class Block:
    """Items (ids, None for null), each with the places of its terms in `terms`, sorted hashes with their weights."""

    items: list[int | None]
    places: list[np.ndarray]
    terms: np.ndarray
    weights: np.ndarray

    def matrix(self) -> np.ndarray:
        """The weights by sketch coordinate and item."""
        out = np.zeros((SKETCH, len(self.items)), np.float32)
        for i, at in enumerate(self.places):
            np.add.at(out[:, i], (self.terms[at] >> U64(64 - SKETCH_BITS)).astype(np.int64), self.weights[at].astype(np.float32))
        return out


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a batch of binary values, and how many each value has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def _holders(terms: np.ndarray) -> Callable:
    """How many documents of a task hold each of the (sorted) terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches(it, 4000, 8 << 20):
            has, _ = _values(batch.column(0), np.uint64)
            at = np.minimum(np.searchsorted(terms, has), len(terms) - 1)
            total += np.bincount(at[terms[at] == has], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["place", "df"])

    return run


class Best:
    """The best documents of one item so far: scores, ids, and which ids are null."""

    def __init__(self, limit: int):
        self.limit, self.scores, self.ids, self.nulls = limit, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Below this score no document gets in."""
        return int(self.scores[-1]) if len(self.scores) == self.limit else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        some = scores >= self.least()
        if some.any():
            scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores[some]), (self.ids, ids[some]), (self.nulls, nulls[some])))
            first = np.lexsort((ids, nulls, -scores))[: self.limit]
            self.scores, self.ids, self.nulls = scores[first], ids[first], nulls[first]


def bounds(doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """An upper bound of the score of every document (rows; of length norm m) for every item. Terms are sorted in each document, so those of one coordinate stand together; within a document the largest impact is that of the largest count."""
    cell = doc * SKETCH + (terms >> U64(64 - SKETCH_BITS)).astype(np.int64)
    sketch = np.zeros(len(m) * SKETCH, np.float32)
    if len(cell):
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        most = np.maximum.reduceat(counts, first).astype(np.float64)
        sketch[cell[first]] = 1e9 * most / (1000 * most + 8 * m[doc[first]])
    return (sketch.reshape(len(m), SKETCH) @ matrix) * np.float32(SLACK)


def _search(block: Block, n_docs: int, n_words: int, limit: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, width = block.matrix(), len(block.terms)
        best = [Best(limit) for _ in block.items]
        for batch in batches(it, SEARCHED, 8 << 20):
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            m = 100 - 90 + 90 * batch.column(1).to_numpy() * n_docs // n_words
            terms, size = _values(batch.column(2), np.uint64)
            counts = _values(batch.column(3), np.uint32)[0].astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), size)
            most = bounds(doc, terms, counts, m, matrix)
            # The exact impacts of asked terms, in order of document and term.
            at = np.minimum(np.searchsorted(block.terms, terms), width - 1)
            asked = np.flatnonzero(block.terms[at] == terms)
            cell, tf = doc[asked] * width + at[asked], counts[asked]
            impact = np.append(1_000_000_000 * tf // (1000 * tf + 8 * m[doc[asked]]), 0)
            cell = np.append(cell, -1)  # what is not found points here
            for i, (place, kept) in enumerate(zip(block.places, best, strict=True)):
                bound = most[:, i]
                left = np.flatnonzero(bound >= kept.least())
                left = left[np.argsort(-bound[left])]
                while len(left) and bound[left[0]] >= kept.least():
                    chunk, left = left[:CHUNK], left[CHUNK:]
                    wanted = chunk[:, None] * width + place
                    found = np.searchsorted(cell[:-1], wanted)
                    found = np.where(cell[found] == wanted, found, len(cell) - 1)
                    kept.add(impact[found] @ block.weights[place], ids[chunk], nulls[chunk])
        for item, kept in zip(block.items, best, strict=True):
            n = len(kept.scores)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(kept.ids, pa.int64(), mask=kept.nulls), pa.array(kept.scores)], names=["item_id", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(asked: list[tuple[int | None, int]], index: DataFrame, n_docs: int) -> Block | None:
    """The items of one block, with the weights of those of their terms that some document holds."""
    terms = np.unique(np.array([t for _, t in asked], np.int64).view(U64))
    counted = index.select("terms").mapInArrow(_holders(terms), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    df = {r["place"]: r["df"] for r in counted}
    some = np.array(sorted(p for p, n in df.items() if weight(n_docs, n) > 0), np.int64)
    if not len(some):
        return None
    weights, by_item = np.array([weight(n_docs, df[int(p)]) for p in some], np.int64), {}
    for item, term in asked:
        by_item.setdefault(item, []).append(term)
    places = [some.searchsorted(np.intersect1d(np.searchsorted(terms, np.array(x, np.int64).view(U64)), some)) for x in by_item.values()]
    return Block(list(by_item), places, terms[some], weights)


def search(index: DataFrame, items: DataFrame, limit: int = LIMIT, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, a written table. index: by build_index."""
    n_docs, n_words = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    asked = materialize(texts.mapInArrow(_asked_rows, "item_id long, term long").distinct(), "asked")
    n_items, n_terms = asked.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.count("*")).first()
    n_blocks = max(-(-n_items // BLOCK_ITEMS), -(-n_terms // BLOCK_TERMS))
    found = items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks if n_words else 0):
        mine = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()]
        block = _block(mine, index, n_docs) if mine else None
        if block:
            best = index.mapInArrow(_search(block, n_docs, n_words, limit), "item_id long, doc_id long, score long")
            order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.unionByName(materialize(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("item_id", "rank", "doc_id", "score"), "ranked"))
    discard(asked)
    return found


def ranked(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """search over an index that is built for it and deleted afterwards."""
    index = build_index(docs)
    found = search(index, items, limit)
    discard(index)
    return found
