"""Language by string kernels: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of character n-grams (1 to NGRAM letters) found in both, over the root of the product
of their numbers of distinct n-grams. LANDMARKS training texts span the feature space; ridge regression in it gives one score
for each language. A score is linear in the presence vector of a text, so landmarks and weights fold into one matrix of
BUCKETS x languages, and a batch of texts is scored by one matrix product.

A text of more than WINDOW letters is scored as the mean over equal windows that cover it whole, as the presence vector of a
very long text would fill up with chance n-grams and tell less and less.

The classifier is fitted on a bounded sample: about PER_LANGUAGE rows of each language, TRAIN_ROWS in all (so of TRAIN_ROWS
languages at most, the most frequent ones), drawn by a hash of the id, and of each such row one window, chosen by that hash.
So at most TRAIN_ROWS * WINDOW letters come to the driver. Prediction covers whole texts.

Defined cases: null text or text without a letter is `und` with score 0; a very long text is scored whole, by windows; a
training row without text is left out; without any training row everything is `und`; ties go to the language that sorts first;
repeated rows are scored alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .wordhash import batches

NGRAM = 4
BUCKETS = 1 << 15
PER_LANGUAGE, TRAIN_ROWS = 300, 1600
WINDOW = 4096
LANDMARKS = 240
RIDGE = 0.1
#: Steepness of the score as a probability.
SHARP = 6.0
MODULUS, HELD_OUT = 4, 2


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray


def presence(codes: np.ndarray, out: np.ndarray) -> None:
    """Marks in a row of BUCKETS the n-grams of lower-case letters."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, NGRAM + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        out[((h * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)] = 1


def windows(text: str) -> list[np.ndarray]:
    """The letters of a text in lower case, cut into equal windows of at most WINDOW."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.array_split(codes, -(-len(codes) // WINDOW)) if len(codes) else [codes]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _matrix(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.zeros((len(parts), BUCKETS), np.uint8)
    for row, part in zip(rows, parts, strict=True):
        presence(part, row)
    return rows


def _kernel(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Normalised kernel of the rows of x with the landmarks y (float32)."""
    out = np.empty((len(x), len(y)), np.float64)
    for at in range(0, len(x), 128):
        out[at : at + 128] = x[at : at + 128].astype(np.float32) @ y.T
    return out / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))[:, None] / np.sqrt(np.maximum(sizes, 1))


def fit(texts: list[str], langs: list[str]) -> Model:
    """From training texts, in a fixed order."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    parts = [windows(t) for t in texts]
    langs = [g for g, p in zip(langs, parts, strict=True) for _ in p]
    x = _matrix([w for p in parts for w in p])
    code = np.array([languages.index(g) for g in langs])
    # The same number of landmarks from each language, as far as it has them.
    turn = np.zeros(len(code), np.int64)
    for k in range(len(languages)):
        turn[code == k] = np.arange((code == k).sum())
    marks = np.argsort(turn, kind="stable")[:LANDMARKS]
    landmark = x[marks].astype(np.float32)
    sizes = x[marks].sum(axis=1, dtype=np.int64)
    among = _kernel(x[marks], landmark, sizes)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # Nystroem: features are kernel rows times this
    features = _kernel(x, landmark, sizes) @ root
    target = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Languages weigh alike, whatever the number of their rows.
    weight = 1.0 / np.bincount(code, minlength=len(languages))[code]
    weight *= len(code) / weight.sum()
    mean = (weight[:, None] * features).sum(axis=0) / weight.sum()
    bias = (weight[:, None] * target).sum(axis=0) / weight.sum()
    centred = features - mean
    beta = np.linalg.solve(centred.T @ (weight[:, None] * centred) + RIDGE * np.eye(centred.shape[1]), centred.T @ (weight[:, None] * (target - bias)))
    alpha = root @ beta
    folded = landmark.T @ (alpha / np.sqrt(np.maximum(sizes, 1))[:, None])
    return Model(languages, folded.astype(np.float32), bias - mean @ beta)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Texts x languages, one matrix product for each block of windows."""
    parts, owner = [], []
    total, number = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))

    def block() -> None:
        x = _matrix(parts)
        norm = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
        np.add.at(total, owner, (x.astype(np.float32) @ model.weights) / norm[:, None] + model.bias)
        np.add.at(number, owner, 1)
        parts.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for part in windows(text):
            parts.append(part)
            owner.append(i)
            if len(parts) == 64:
                block()
    if parts:
        block()
    return total / number[:, None]


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Training texts and languages: rows not held out, drawn by a hash of the id at a rate that gives each language about its share."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", MODULUS), F.lit(-1)) != HELD_OUT))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TRAIN_ROWS).collect()
    if not counts:
        return [], []
    rates = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, min(PER_LANGUAGE, TRAIN_ROWS / len(counts)) / r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < F.coalesce(rates[F.col("lang")], F.lit(0.0))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / WINDOW))
    long = F.ceil(F.length("text") / n).cast("int")
    drawn = drawn.select("lang", F.substring("text", (F.pmod(F.xxhash64("doc_id"), n) * long + 1).cast("int"), long).alias("text"))
    rows = [(r["text"], r["lang"]) for r in drawn.toLocalIterator() if has_letter(r["text"])]
    return [t for t, _ in rows], [g for _, g in rows]


def _predict(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1024, 4 << 20):
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            if some:
                s = scores(model, [texts[i] for i in some])
                best = s.argmax(axis=1)
                odds = np.exp(SHARP * (s - s.max(axis=1, keepdims=True)))
                score[some] = odds.max(axis=1) / odds.sum(axis=1)
                for i, k in zip(some, best, strict=True):
                    lang[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; fits a model on docs where none is given."""
    model = model or fit(*sample(docs, id_col, text_col, lang_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
