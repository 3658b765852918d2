"""Importance resampling toward a target by hashed word runs, with a head and a tail of the vocabulary.

A document's features are its runs of 1 to `runs` (1 or 2) words, and a feature's bucket is its CRC-32 modulo BUCKETS. A bucket's
gain compares its share among the target's features with that among all documents; a document's weight is the mean gain of
its features, and weight plus fixed Gumbel noise orders the draw, so that documents are drawn without replacement in proportion
to their importance.

Head and tail: words that are frequent in some part of the corpus are broadcast with the state of their CRC, frequent pairs with their
bucket; at most HEAD of each. Any other word takes its CRC directly, byte by byte for all words of a batch at once, and any other
pair goes on from its first word's state. Both ways give the same numbers, so the head changes the cost alone.
A word with at least one part in SHARE of all words has that share in some batch, so it is a candidate for the head.

The bucket totals count every feature of every document. A draw's ranks come from one range shuffle of the documents
that can be drawn: a histogram of the scores (whole numbers, some 10^5 of them at most) tells which those are.

Words are looked up in the head by a 64-bit hash: with 65,536 head words, one of 10^9 others is taken for one of them with a
probability of 4e-6.

Defined cases: null text has no words and weight 0; a very long text is read whole; a repeated row is a document of its own;
equal scores are drawn by id, null ids last (their noise is that of an empty id), then in any order, as such rows are alike; without
documents of at least `least_words` words, nothing is drawn; an empty target has no features, and every bucket then counts one;
empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .lexical_search import BREAK, _binary, _values
from .wordhash import U64, Texts, batches, hashes, windows

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
HEAD, SHARE = 65_536, 4_096
#: Words of more bytes take the CRC of the public library, one by one.
LONG = 64
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"

_NONE = np.uint32(0xFFFFFFFF)
_STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # the table of the CRC, by rule


def crc_states(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The states of CRC-32 after data[start:end], going on from `state` (from the beginning where it is None). The CRC itself is the inverse of its state."""
    out = np.full(len(start), _NONE) if state is None else state.copy()
    size = end - start
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(~out[i])) ^ 0xFFFFFFFF
    live = np.flatnonzero((size > 0) & (size <= LONG))
    step = 0
    while len(live):
        s = out[live]
        out[live] = _STEP[(s ^ data[start[live] + step]) & np.uint32(255)] ^ (s >> np.uint32(8))
        step += 1
        live = live[size[live] > step]
    return out


def _bucket(state: np.ndarray, n: int) -> np.ndarray:
    return (~state % np.uint32(n)).astype(np.uint16)


@dataclass
class Head:
    """Sorted hashes of frequent words with their CRC states, and of frequent pairs with their buckets."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    states: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values at the wanted keys, and where a key was not there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype), np.arange(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], np.flatnonzero(keys[at] != wanted)


class Words:
    """The words of a batch, lower-cased and joined by one blank: data[start:end], their texts and hashes."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        low = texts.lower_ascii()
        start, end, self.doc = texts.spans(BREAK)
        size, self.n = end - start, texts.n
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.data = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.end] = False
        self.data[inside] = low[~BREAK[low]]
        self.hashes = hashes(self.data, self.start, self.end)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every two words in a row of one text."""
        return windows(self.hashes, self.doc, 2)


def word_states(words: Words, head: Head) -> np.ndarray:
    out, tail = _look_up(head.words, head.states, words.hashes)
    out[tail] = crc_states(words.data, words.start[tail], words.end[tail])
    return out


def pair_buckets(words: Words, states: np.ndarray, head: Head, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first word of every pair."""
    pair, first = words.pairs()
    out, tail = _look_up(head.pairs, head.buckets, pair)
    at = first[tail]
    out[tail] = _bucket(crc_states(words.data, words.end[at], words.end[at + 1], states[at]), n)
    return out, first


def _frequent(runs: int, n: int) -> Callable:
    """(kind, hash, value, count) of what makes at least one part in SHARE of a batch: 1 for words with their states, 2 for pairs with their buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            words = Words(batch.column(0))
            for kind in range(1, runs + 1):
                of, first = (words.hashes, np.arange(len(words.hashes))) if kind == 1 else words.pairs()
                keys, at, count = np.unique(of, return_index=True, return_counts=True)
                often = np.flatnonzero((count * SHARE >= len(of)) & (count > 1))
                keys, at, count = keys[often], first[at[often]], count[often]
                value = crc_states(words.data, words.start[at], words.end[at + kind - 1])
                value = value if kind == 1 else _bucket(value, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(value.astype(np.int64)), pa.array(count.astype(np.int64))], names=["kind", "key", "value", "n"])

    return run


def head_of(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> Head:
    """The HEAD most frequent words (and pairs) of a column `text`, at most."""
    counted = texts.select("text").mapInArrow(_frequent(runs, buckets), "kind int, key long, value long, n long").groupBy("kind", "key").agg(F.first("value").alias("value"), F.sum("n").alias("n"))
    found = []
    for kind, dtype in ((1, np.uint32), (2, np.uint16)):
        rows = counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(HEAD).select("key", "value").toArrow() if kind <= runs else None
        keys, values = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "value")) if rows else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys.view(U64))
        found += [keys.view(U64)[order], values[order].astype(dtype)]
    return Head(*found)


def _feature_rows(head: Head, runs: int, n: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            words = Words(batch.column(1))
            states = word_states(words, head)
            found, doc = _bucket(states, n), words.doc
            n_words = np.bincount(doc, minlength=batch.num_rows)
            if runs == 2:
                more, first = pair_buckets(words, states, head, n)
                found, doc = np.concatenate([found, more]), np.concatenate([doc, words.doc[first]])
                order = np.argsort(doc, kind="stable")
                found, doc = found[order], doc[order]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(np.diff(cuts), pa.int64()), _binary(found, cuts)], names=["doc_id", "n_words", "n_features", "buckets"])

    return run


def features(texts: DataFrame, head: Head, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of all features (16-bit numbers), of rows (doc_id, text)."""
    return texts.mapInArrow(_feature_rows(head, runs, buckets), FEATURES)


def _totals(n: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches(it, 10_000, 8 << 20):
            total += np.bincount(_values(batch.column(0), np.uint16)[0], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n), exact: each task sends a row for each bucket at most."""
    return found.select("buckets").mapInArrow(_totals(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, a number of rows fixed by a parameter, from the totals of both sides."""
    s, t = (dict(map(tuple, x.collect())) for x in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    of = [(t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets)) for b in range(buckets)]
    return np.floor(1000 * np.log(np.array(of))).astype(np.int64)


def _weighed(gain: np.ndarray) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 10_000, 8 << 20):
            found, size = _values(batch.column(3), np.uint16)
            total = np.concatenate([[0], np.cumsum(gain[found])])
            end = np.cumsum(size)
            weight = (total[end] - total[end - size]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with their number in the order of score (highest first) and id, from 1: one range shuffle, then the counts of the partitions before. `tie` parts rows with equal ids."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = 0, []
    for p, n in sorted(map(tuple, placed.groupBy(part).count().collect())):
        sizes.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(sizes, "_part long, _before long")
    return placed.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part").withColumn("number", F.col("_before") + at + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is null for what is not drawn. target: a column `text`."""
    if runs not in (1, 2) or not 0 < buckets <= 65_536:
        raise ValueError("runs is 1 or 2, and buckets are 65536 at most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    head = head_of(texts, runs, buckets)
    found = materialize(features(texts, head, runs, buckets), "features")
    wanted = features(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text")), head, runs, buckets)
    gain = gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets), buckets)
    weighed = found.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "tie": F.monotonically_increasing_id()}), "scored")
    discard(found)

    able = F.col("n_words") >= least_words
    count = sorted(map(tuple, scored.where(able).groupBy("score").count().collect()), reverse=True)
    drawn = sum(n for _, n in count) * percent // 100
    least, seen = None, 0
    for value, n in count:
        if seen < drawn:
            least, seen = value, seen + n
    out = scored.select("doc_id", "n_features", "weight", "score")
    if least is None:
        return out.withColumn("rank", F.lit(None).cast("long"))
    first = able & (F.col("score") >= least)
    number = _numbered(scored.where(first)).select("doc_id", "n_features", "weight", "score", F.when(F.col("number") <= drawn, F.col("number")).alias("rank"))
    return scored.where(~first).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")).unionByName(number)
