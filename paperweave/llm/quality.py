"""Quality rules by distribution divergence.

Each language of the corpus gets a reference: the share of each character class, and of its most common words and all others.
A document is compared by the Jensen-Shannon distance (base 2, so 0 to 1) of both histograms with the reference of its own language and
with those of the MOST_COMPARED largest languages, and is held to the closest one; so further rows of other languages can never
cost a document its place. A document whose own language has no reference is not judged by divergence; neither is a
histogram below a minimum length, which says too little. Texts stay whole, and the counts behind the references cover all documents.

The bounds MAX_CHAR_DISTANCE and MAX_WORD_DISTANCE are parameters. At 0.28 bits by class and 0.45 by common word, prose keeps a
margin (a clean text of GUARD_WORDS words lies near 0.1 and 0.3), while texts of which a third of the words carry marks, or
that use next to none of a language's common words, lie beyond.

Defined cases: null or blank text has no words and fails the base rule; a very long text is counted whole; a null lang is a
language of its own; languages with fewer than REFERENCE_WORDS words, and those after the MOST_REFERENCES largest, give no
reference, whatever their share of the corpus, and for their documents the base rule alone decides; a tie between references
goes to the larger language (of equal ones to the first by name), and between common words to the smaller hash; repeated rows are judged alike; null ids stay null; an
empty table gives an empty result; other columns are ignored, and returned by keep_good, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, row_columns, whole_row
from .wordhash import SPACE, U64, Texts, batches, hashes, mix, windows

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_SIZE = 20, 30, 8
COMMON_WORDS = 40
#: Guards: from so many characters and words on, the histograms are compared.
GUARD_CHARS, GUARD_WORDS = 200, 60
#: Distances beyond which a document differs from every reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.45
#: Words from which on a language gives a reference; references that every document is compared with, and references in all (49 numbers each, sent to every task).
REFERENCE_WORDS, MOST_COMPARED, MOST_REFERENCES = 2000, 50, 10_000
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
#: Distinct words that a task adds up before it sends them; what it sorts at once stays small, as a Python worker keeps its memory through later stages.
HELD = 400_000
#: Bytes of texts that are worked on at once: some 60 bytes of work arrays for each.
BATCH = 1 << 18

LINE = np.zeros(256, bool)
LINE[10] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True
#: Classes by byte: 0 lower case, 1 capital, 2 digit, 3 blank, 4 line end or control, 5 sentence mark, 6 other ASCII mark, 7 letter beyond ASCII, 8 its further bytes (not counted).
CLASSES = 8
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[:32] = 0, 1, 2, 3, 4
_CLASS[[*b".,;:!?'\"()-"]] = 5
_CLASS[128:192], _CLASS[192:] = 8, 7


@dataclass
class References:
    """Row by row for each language, the largest first: its name, class shares, the sorted hashes of its common words, their shares, and last the share of all others."""

    langs: list[str | None]
    chars: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def class_counts(texts: Texts) -> np.ndarray:
    doc = np.repeat(np.arange(texts.n), np.diff(texts.bounds))
    return np.bincount(doc * 9 + _CLASS[texts.bytes], minlength=texts.n * 9).reshape(texts.n, 9)[:, :CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, the square root of the Jensen-Shannon divergence in bits; rows of p and q sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1)
        return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0))


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: kind 0 for character classes, 1 for word hashes. A task adds up its batches before it sends them."""
    held: dict[str | None, list] = {}
    size = 0  # of what is held

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (chars, keys, counts) in held.items():
            k, n = merged(keys, counts)
            for kind, a, b in ((0, np.arange(CLASSES), chars), (1, k.view(np.int64), n)):
                for at in range(0, len(a), 50_000):
                    x, y = a[at : at + 50_000], b[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array([kind] * len(x), pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["lang", "kind", "key", "n"])
        held.clear()

    def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64)

    for batch in batches(it, size=BATCH):
        texts = Texts(batch.column(0))
        langs = batch.column(1).to_pylist()
        start, end, doc = texts.spans(SPACE)
        words, chars = hashes(texts.lower_ascii(), start, end), class_counts(texts)
        names = list(dict.fromkeys(langs))
        code = np.array([names.index(x) for x in langs], np.int64) if len(names) < 50 else np.array([{x: i for i, x in enumerate(names)}[x] for x in langs], np.int64)
        for i, lang in enumerate(names):
            k, n = np.unique(words[code[doc] == i], return_counts=True)
            c, ks, ns = held.setdefault(lang, [np.zeros(CLASSES, np.int64), [], []])
            c += chars[code == i].sum(axis=0)
            ks.append(k)
            ns.append(n)
            size += len(k)
            if len(ks) > 8 and sum(map(len, ks)) > 2 * len(ks[0]):  # in proportion to what was merged before
                size -= sum(map(len, ks))
                k, n = merged(ks, ns)
                held[lang][1:] = [k], [n]
                size += len(k)
        if size > HELD:
            yield from flush()
            size = 0
    yield from flush()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Counted over all documents. What comes to the driver is COMMON_WORDS + CLASSES rows for each language."""
    counts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    best = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "key"))
    salted = counts.withColumn("salt", F.pmod(F.hash("key"), F.lit(64)))
    words = salted.where("kind = 1").withColumn("r", best("salt")).where(F.col("r") <= COMMON_WORDS).withColumn("r", best()).where(F.col("r") <= COMMON_WORDS)
    totals = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("key"), "n")
    totals = materialize(totals, "languages")
    large = [r["lang"] for r in totals.where(F.col("n") >= REFERENCE_WORDS).orderBy(F.desc("n"), F.asc_nulls_first("lang")).limit(MOST_REFERENCES).select("lang").collect()]
    # MOST_REFERENCES rows at most, as an Arrow table: rows of Python objects would start further Python workers on the executors, which stay.
    wanted = docs.sparkSession.createDataFrame(pa.table({"of": pa.array(large, pa.string())}))
    of_large = F.col("lang").eqNullSafe(F.col("of"))
    rows = words.select("lang", "kind", "key", "n").unionByName(counts.where("kind = 0")).unionByName(totals).join(F.broadcast(wanted), of_large, "left_semi").collect()
    if rows:  # an empty result can come before all of its stages have ended
        discard(counts, totals)
    by: dict = {}
    for r in rows:
        by.setdefault(r["lang"], {0: {}, 1: {}, 2: {}})[r["kind"]][r["key"]] = r["n"]
    chars, words_of, shares = [], [], []
    for lang in large:
        c, w, total = by[lang][0], by[lang][1], by[lang][2].get(0, 0)
        pairs = sorted(w.items())
        pairs += [(0, 0)] * (COMMON_WORDS - len(pairs))
        k = np.array([x for x, _ in pairs], np.int64)
        n = np.array([x for _, x in pairs], float)
        order = np.argsort(k.view(U64), kind="stable")
        chars.append(np.array([c.get(i, 0) for i in range(CLASSES)], float) / max(1, sum(c.values())))
        words_of.append(k.view(U64)[order])
        shares.append(np.append(n[order], total - n.sum()) / total)
    return References(large, np.array(chars).reshape(-1, CLASSES), np.array(words_of, U64).reshape(-1, COMMON_WORDS), np.array(shares).reshape(-1, COMMON_WORDS + 1))


def _distances(texts: Texts, words: np.ndarray, doc: np.ndarray, n_words: np.ndarray, own: np.ndarray, ref: References) -> tuple[np.ndarray, np.ndarray]:
    """Of every text that has an own reference (its number, else -1), char and word distance from the closest one; 0 where the text is too short for one, or has none."""
    chars = class_counts(texts)
    total = chars.sum(axis=1)
    closest = np.where(own >= 0, np.inf, 0)
    char_d, word_d = np.zeros(texts.n), np.zeros(texts.n)
    judged = own >= 0
    for k in dict.fromkeys([*range(min(MOST_COMPARED, len(ref.langs))), *own[judged].tolist()]):
        some = judged if k < MOST_COMPARED else own == k
        by_char, by_word = np.zeros(texts.n), np.zeros(texts.n)
        long, wordy = some & (total >= GUARD_CHARS), some & (n_words >= GUARD_WORDS)
        by_char[long] = js_distance(chars[long] / total[long, None], ref.chars[k])
        at = np.minimum(np.searchsorted(ref.words[k], words), COMMON_WORDS - 1)
        at = np.where(ref.words[k][at] == words, at, COMMON_WORDS)
        hist = np.bincount(doc * (COMMON_WORDS + 1) + at, minlength=texts.n * (COMMON_WORDS + 1)).reshape(texts.n, -1)
        by_word[wordy] = js_distance(hist[wordy] / n_words[wordy, None], ref.shares[k])
        worst = np.maximum(by_char / MAX_CHAR_DISTANCE, by_word / MAX_WORD_DISTANCE)
        nearer = some & (worst < closest)
        closest[nearer], char_d[nearer], word_d[nearer] = worst[nearer], by_char[nearer], by_word[nearer]
    return char_d, word_d


def repeated(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words that lie in windows of REPEAT_SIZE words found twice or more in it."""
    grams, at = windows(words, doc, REPEAT_SIZE)
    _, back, times = np.unique(mix(grams ^ mix(doc[at].astype(U64) + U64(1))), return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    twice = at[times[back] > 1] if len(at) else at
    np.add.at(step, twice, 1)
    np.add.at(step, np.minimum(twice + REPEAT_SIZE, len(words)), -1)
    return np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=n)


def dup_lines(texts: Texts, n: int) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    start, end, doc = texts.spans(LINE)
    solid = np.concatenate([[0], np.cumsum(~SPACE[texts.bytes])])
    some = solid[end] > solid[start]
    start, end, doc = start[some], end[some], doc[some]
    h = mix(hashes(texts.bytes, start, end) ^ mix(doc.astype(U64) + U64(1)))
    _, first = np.unique(h, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def _verdicts(column: pa.Array, langs: pa.Array, ref: References) -> dict[str, np.ndarray]:
    texts = Texts(column)
    start, end, doc = texts.spans(SPACE)
    n_words = np.bincount(doc, minlength=texts.n)
    plain = hashes(texts.bytes, start, end)
    repeat = repeated(plain, doc, texts.n)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    number = {x: k for k, x in enumerate(ref.langs)}
    own = np.array([number.get(x, -1) for x in langs.to_pylist()], np.int64)
    char_d, word_d = _distances(texts, hashes(texts.lower_ascii(), start, end), doc, n_words, own, ref)
    kept = ~failed & (char_d <= MAX_CHAR_DISTANCE) & (word_d <= MAX_WORD_DISTANCE)
    solid = ~SPACE[texts.bytes] & ((texts.bytes & 0xC0) != 0x80)
    return {
        "n_words": n_words, "word_chars": texts.sums(solid), "n_symbols": texts.sums(SYMBOL[texts.bytes]), "n_dup_lines": dup_lines(texts, texts.n), "n_repeat_words": repeat,
        "base_failed": failed, "char_distance": char_d, "word_distance": word_d, "kept": kept,
    }


def _judge(ref: References):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, size=BATCH):
            found = _verdicts(batch.column(1), batch.column(2), ref)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64() if x.dtype.kind in "iu" else None) for x in found.values()]], names=["doc_id", *found])

    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ref: References | None = None) -> DataFrame:
    """One row for every row of docs, see COUNTS."""
    ref = ref or references(docs, text_col, lang_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_judge(ref), COUNTS)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ref: References | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns and without a join."""
    ref = ref or references(docs, text_col, lang_col)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (pa.RecordBatch.from_arrays([b.column(0).field(text), b.column(0).field(lang).cast(pa.string()), b.column(0)], names=["text", "lang", "row"]) for b in it)
        for batch in batches(parts, size=BATCH):
            kept = _verdicts(batch.column(0), batch.column(1), ref)["kept"]
            yield pa.RecordBatch.from_arrays([batch.column(2)], names=["row"]).filter(pa.array(kept))

    rows = docs.select(whole_row(docs).alias("row"))
    return rows.mapInArrow(run, rows.schema).select(*row_columns(docs.columns))
