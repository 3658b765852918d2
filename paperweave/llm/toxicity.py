"""Toxicity by a counterfactually regularised classifier.

Logistic regression on the presence of words. For every labelled text that names a group, a counterfactual text is made by
swapping identity terms for others of the same kind; the training loss penalises the squared change of the logit between the
two, so that naming a group as such moves no score.

The classifier is fitted on a bounded sample of labelled rows (at most about PER_CLASS of each class, drawn by a hash of the
id) and at most FEATURES words, those that tell the classes apart best in it; they are counted and chosen in Spark, so what
comes to the driver is bounded by 3 * PER_CLASS rows of that many features, however long the texts are. Scoring covers whole
texts.

Defined cases: null or empty text scores by the intercept alone; a very long text counts by its distinct words like any other;
words that tell the classes apart equally well are taken by their hashes; a document labelled twice counts as toxic if any
label says so; null labels and null ids among the labels are left out; without labels of both classes every score is the share
of toxic labels, 0.5 if there are none; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialize
from .wordhash import U64, Texts, batches, hashes

PER_CLASS = 4000
FEATURES = 600
LEAST_ROWS = 5
L2, SWAP_PENALTY = 1.0, 5.0
MODULUS, HELD_OUT = 5, 0

#: Identity terms by kind; each is swapped for the next of its row.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("she", "he"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("homosexual", "bisexual"), ("transgender", "cisgender"), ("trans", "queer"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "native"), ("immigrants", "natives"), ("refugee", "citizen"), ("refugees", "citizens"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young"), ("elderly", "teenage"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "musulmans", "chrétiens"), ("mujeres", "hombres"), ("judíos", "musulmanes", "cristianos"),
)

#: Everything but letters, digits and bytes beyond ASCII separates words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float


def _hash_words(words: list[str]) -> np.ndarray:
    texts = Texts(pa.array(words, pa.string()))
    return hashes(texts.bytes, texts.bounds[:-1], texts.bounds[1:])


def swaps() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of identity terms, sorted, and of what each is swapped for."""
    pairs = [(a, row[(i + 1) % len(row)]) for row in IDENTITY for i, a in enumerate(row)]
    a, b = (_hash_words([p[k] for p in pairs]) for k in (0, 1))
    order = np.argsort(a)
    return a[order], b[order]


def document_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the distinct lower-case words of every text and the text numbers."""
    texts = Texts(column)
    start, end, doc = texts.spans(APART)
    h = hashes(texts.lower_ascii(), start, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first], texts.n


def _training_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        h, doc, n = document_words(batch.column(1))
        cut = np.searchsorted(doc, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h[cut[i] : cut[i + 1]].view(np.int64) for i in range(n)], pa.list_(pa.int64()))], names=["doc_id", "toxic", "words"])


@dataclass
class Sample:
    """Training rows: sorted feature hashes, labels, presence of the features, and for the rows that name a group their numbers and what swapping changes."""

    features: np.ndarray
    toxic: np.ndarray
    present: np.ndarray
    named: np.ndarray
    change: np.ndarray


def _indexed(features: np.ndarray):
    """Of each training row the numbers of the features that it has, and, where it names a group, of those it has after swapping."""
    old, new = swaps()

    def numbers(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(features, h), len(features) - 1)
        return np.unique(at[features[at] == h]) if len(features) else np.zeros(0, np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [np.array(x or [], np.int64).view(U64) for x in batch.column(2).to_pylist()]
            has, swapped = [], []
            for h in rows:
                at = np.minimum(np.searchsorted(old, h), len(old) - 1)
                named = old[at] == h
                has.append(numbers(h))
                swapped.append(numbers(np.where(named, new[at], h)) if named.any() else None)
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(has, ints), pa.array(swapped, ints)], names=["doc_id", "toxic", "has", "swapped"])

    return run


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """The drawn labels are bounded and broadcast; no text is shuffled, and no text and no list of words leaves the executors."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", MODULUS) != HELD_OUT)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    none = np.zeros((0, 0), np.float32)
    if not counts:
        return Sample(np.zeros(0, U64), np.zeros(0), none, np.zeros(0, np.int64), none)
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, PER_CLASS / n)))])[F.col("toxic")]
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < rate).orderBy(F.xxhash64("doc_id")).limit(3 * PER_CLASS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_training_words, "doc_id long, toxic int, words array<long>"), "training")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = n1 / n if n else 0.0
    words = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    # How far a word's toxic share lies from the overall one, in standard errors. Identity terms are features whenever they occur, so that the penalty can hold them.
    z = F.abs(F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    best = words.where(F.col("n") >= LEAST_ROWS).orderBy(z.desc(), "word").limit(FEATURES).select("word")
    terms = words.where(F.col("word").isin(swaps()[0].view(np.int64).tolist())).select("word")
    chosen = sorted({r["word"] & (1 << 64) - 1 for r in best.unionByName(terms).collect()})
    features = np.array(chosen, U64)
    found = rows.mapInArrow(_indexed(features), "doc_id long, toxic int, has array<long>, swapped array<long>").toArrow().to_pylist()
    found.sort(key=lambda r: r["doc_id"])
    discard(rows)
    present = np.zeros((len(found), len(features)), np.float32)
    named = np.array([i for i, r in enumerate(found) if r["swapped"] is not None], np.int64)
    change = np.zeros((len(named), len(features)), np.float32)
    for row, r in zip(present, found, strict=True):
        row[r["has"]] = 1
    for row, i in zip(change, named, strict=True):
        row[found[i]["swapped"]] = 1
        row -= present[i]
    return Sample(features, np.array([r["toxic"] for r in found], float), present, named, change)


def fit(rows: Sample, steps: int = 300) -> Model:
    toxic, x, swapped, features = rows.toxic, rows.present, rows.change, rows.features
    if not len(toxic) or toxic.min() == toxic.max():
        share = toxic.mean() if len(toxic) else 0.5
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w, b = np.zeros(len(features)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        low = w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x @ low + b, -30, 30)))
        slope = (weight * (p - toxic)).astype(np.float32)
        change = swapped @ low
        g = np.append(x.T @ slope + L2 * w / len(toxic) + SWAP_PENALTY * (swapped.T @ change) / max(1, len(change)), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(features, w, float(b))


def _score(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            h, doc, n = document_words(batch.column(1))
            logit = np.full(n, model.intercept)
            if len(model.words) and len(h):
                at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                hit = model.words[at] == h
                logit += np.bincount(doc[hit], model.weights[at[hit]], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; fits a model on docs and labels where none is given."""
    model = model or fit(sample(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
