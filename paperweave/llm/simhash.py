"""SimHash near-duplicates: fingerprints of 64 bits and a binary trie joined with itself.

Fingerprint: the XXH64 hashes of a text's 3-word shingles vote on each bit. Equal fingerprints are one class, known by its smallest
id, so that copies never meet in pairs. Two classes are linked if their fingerprints differ in at most BUDGET bits.

The join walks pairs of nodes of a trie over the fingerprints from the root down, one bit at a time and all pairs of a level at once.
A pair of children on different branches has one more differing bit; a pair beyond the budget is left out with all below it, and
a pair of single fingerprints is settled at once. Tasks share the work by pigeonhole: BUDGET differing bits leave one of
BUDGET + 1 pieces of the fingerprint equal, so a fingerprint goes to one group for each piece, and only those in one group are
joined. A group of more than MOST is cut again by the pieces of the bits that are still free, and so on; as fingerprints are
distinct, a group with 14 free bits has 16,384 at most. So no group is ever larger than that, whatever the texts are, and no link is lost.

Each task sends, instead of its links, what they connect: one row for each fingerprint at most.

Defined cases: null or blank text has fingerprint zero, linked like any other; fewer than three words make one shingle; a very
long text is read whole; rows repeated whole are copies of one another, and rows with one id and different texts connect what
those texts are linked with; null ids form no links and have a null component; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_heavy, materialize
from .near_dedup import components
from .wordhash import U64, batches

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Fingerprints that one group has at most.
MOST = 1 << 14
#: Node pairs that are expanded at once, and rows that a task gathers before it joins them.
PAIRS, ROWS = 1 << 19, 1 << 17
_SUMMED = 1 << 15


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined, size = b" ".join(words), np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    k = min(SHINGLE, len(words))
    n, digest = len(words) - k + 1, xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[k - 1 :].tolist(), strict=True)), U64, n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, _SUMMED):
        votes += np.unpackbits(h[i : i + _SUMMED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], U64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


# --- the trie joined with itself ------------------------------------------------------------------------------------------
def trie_join(group: np.ndarray, prints: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of prints in one group that differ in at most `budget` bits. Both arrays are sorted by group, then print; prints of a group are distinct.

    A node is a stretch of places whose prints begin alike; a pair of nodes is (a, end of a, b, end of b, differing bits so far), a node with itself being a pair too.
    """
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    root = np.stack([cuts[:-1], cuts[1:], cuts[:-1], cuts[1:], np.zeros(len(cuts) - 1, np.int64)])
    waiting = [(BITS - 1, root)]
    while waiting:
        bit, pairs = waiting.pop()
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        a, b = pairs[0][single], pairs[2][single]
        near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget)
        yield a[near], b[near]
        pairs = pairs[:, ~single]
        if bit < 0 or not pairs.shape[1]:
            continue
        if pairs.shape[1] > PAIRS:
            waiting += [(bit, pairs[:, i : i + PAIRS]) for i in range(0, pairs.shape[1], PAIRS)]
            continue
        ones = np.concatenate([[0], np.cumsum((prints >> U64(bit)) & U64(1), dtype=np.int64)])
        a, a_end, b, b_end, differ = pairs
        a_mid, b_mid = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
        same = [np.stack([a, a_mid, b, b_mid, differ]), np.stack([a_mid, a_end, b_mid, b_end, differ])]
        crossed = [np.stack([a, a_mid, b_mid, b_end, differ + 1]), np.stack([a_mid, a_end, b, b_mid, differ + 1])[:, a != b]]  # of a node with itself, one crossing is enough
        child = np.concatenate([*same, *crossed], axis=1)
        waiting.append((bit - 1, child[:, (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)]))


def connected(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places, the smallest one that the links connect it with."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            some = x != y
            a, b, x, y = a[some], b[some], x[some], y[some]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (deeper := label[label]).tobytes() != label.tobytes():
                label = deeper
    return label


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, print, rep), those of a key together, to rows (a, b) that connect the reps of each chunk of whole groups."""

    def chunk(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, prints, rep = (np.concatenate([p[i] for p in parts]) for i in range(3))
        prints = prints.view(U64)
        order = np.lexsort((prints, key))
        key, prints, rep = key[order], prints[order], rep[order]
        label = connected(len(rep), trie_join(key, prints))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[label[moved]]), pa.array(rep[moved])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in it:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        if rows + len(columns[0]) > ROWS:  # up to the last group's beginning, which may go on in the next batch
            cut = int(np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[-1])
            if cut:
                yield chunk([*held, [c[:cut] for c in columns]])
                held, columns = [], [c[cut:] for c in columns]
            elif held and held[-1][0][-1] != columns[0][0]:
                yield chunk(held)
                held = []
        held.append(columns)
        rows = sum(len(h[0]) for h in held)
    if held:
        yield chunk(held)


# --- groups ---------------------------------------------------------------------------------------------------------------
def piece_masks(depth: int) -> list[int]:
    """The bits that are equal in a group, for each way of `depth` cuts: every cut parts the free bits into BUDGET + 1 pieces and fixes one of them."""
    ways = [(0, list(range(BITS)))]
    for _ in range(depth):
        step = []
        for mask, free in ways:
            at = [len(free) * k // (BUDGET + 1) for k in range(BUDGET + 2)]
            for lo, hi in zip(at, at[1:], strict=False):
                step.append((mask | sum(1 << b for b in free[lo:hi]), free[:lo] + free[hi:]))
        ways = step
    return [mask for mask, _ in ways]


def _cut(rows: DataFrame, depth: int) -> DataFrame:
    """rows (print, rep, way) once for each further piece, with the key of the group: a hash of way and equal bits. Groups that share a hash are joined as one, which makes no false link."""
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in piece_masks(depth)])
    pieces = F.array(*[F.col("way") * (BUDGET + 1) + k for k in range(BUDGET + 1)])
    dealt = rows.select("print", "rep", F.explode(pieces).alias("way"))
    return dealt.withColumn("key", F.xxhash64("way", F.col("print").bitwiseAND(F.element_at(masks, F.col("way") + 1))))


def _groups(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, print, rep) in groups of at most MOST, and the written tables behind it."""
    ready, tables, rows, depth = None, [], classes.select("print", "rep", F.lit(0).alias("way")), 0
    while True:
        depth += 1
        dealt = materialize(_cut(rows, depth), "dealt")
        large = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).withColumn("_large", F.lit(True)), "large")
        tables += [dealt, large]
        if large.isEmpty():
            small = dealt
        else:
            marked = materialize(join_heavy(dealt, large, "key", "n", dealt.count(), "left"), "marked")
            tables.append(marked)
            small, rows = marked.where("_large is null"), marked.where("_large").select("print", "rep", "way")
        small = small.select("key", "print", "rep")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            return ready, tables


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, component_id), one row for every row of docs; print as a signed 64-bit number."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(texts.mapInArrow(_fingerprints, "doc_id long, print long"), "prints")
    classes = materialize(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    groups, tables = _groups(classes)
    links = materialize(groups.repartition("key").sortWithinPartitions("key").mapInArrow(_joined, "a long, b long"), "links")
    # A repeated id can lead several classes.
    comp = components(classes.select("rep").distinct(), links)
    of_class = classes.join(comp, "rep").select("print", "n", F.col("comp").alias("component_id"))
    discard(links, *tables)
    known, alone = prints.where("doc_id is not null"), prints.where("doc_id is null")
    found = join_heavy(known, of_class, "print", "n", prints.count())
    return found.select("doc_id", "print", "component_id").unionByName(alone.select("doc_id", "print", F.lit(None).cast("long").alias("component_id")))


def as_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
