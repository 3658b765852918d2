"""Packing documents into training sequences: best-fit decreasing over a segment tree of remaining capacities.

Every partition packs its own rows, block by block, so nothing is shuffled and no task holds more than a block. A document is
its ids and one end id. Full windows are cut off first and are sequences of their own; the rests are placed in order of
decreasing length, each into the open sequence with the least room that suffices.

Defined cases: null or empty text is the end id alone; a very long text is cut into full windows and a rest; rests of equal
length are placed in order of rows, and of sequences with equal room the one filled last is taken; repeated rows are packed
each; null ids stay null; an empty table gives an empty result; other columns are dropped, whatever their names. Sequence
numbers are unique in a result, not consecutive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import byte_tokens
from .wordhash import batches, give_back

LENGTH, END = 1024, 0
#: A block ends at so many rests or bytes of ids; its size bounds a task's memory. Some 12,000 rests fit each other nearly as well as all would: some three parts in a thousand are padding.
BLOCK_ROWS, BLOCK_BYTES = 60_000, 24 << 20
#: Pieces (4 KB at most) in one Arrow batch.
SENT = 1000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Rooms:
    """Open sequences by room left; a segment tree over the rooms 0..size finds the least one that suffices."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def tightest(self, need: int) -> int | None:
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and not (at & 1 == 0 and count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], size: int = LENGTH) -> tuple[list[int], list[int], int]:
    """For rests of 1..size-1 ids: the sequence and the offset of each, and the number of sequences."""
    rooms, sequence, offset, n = Rooms(size), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = rooms.tightest(lengths[i])
        if room is None:
            room, sequence[i], n = size, n, n + 1
        else:
            sequence[i] = rooms.take(room)
        offset[i] = size - room
        rooms.put(room - lengths[i], sequence[i])
    return sequence, offset, n


def pack_rows(rows: Iterator[tuple], size: int = LENGTH, width: int = 4) -> Iterator[list[tuple]]:
    """Lists of pieces (doc_id, start, length, ids, doc_tokens, sequence, offset); all pieces of a sequence are in one list. rows: (doc_id, ids as bytes of `width` each)."""
    held, kept, out, made = [], 0, [], 0
    used = 0

    def close(out: list, held: list, used: int) -> int:
        places, offsets, n = best_fit([len(x[2]) // width for x in held], size)
        out.extend((d, s, len(b) // width, b, t, used + p, o) for (d, s, b, t), p, o in zip(held, places, offsets, strict=True))
        return used + n

    for doc, ids in rows:
        tokens = len(ids) // width
        whole = tokens // size
        for k in range(whole):
            out.append((doc, k * size, size, ids[k * size * width : (k + 1) * size * width], tokens, used, 0))
            used += 1
        made += whole * size * width
        if tokens % size:
            held.append((doc, whole * size, ids[whole * size * width :], tokens))
            kept += len(held[-1][2])
        if len(held) >= BLOCK_ROWS or kept >= BLOCK_BYTES:
            used = close(out, held, used)
            made += kept
            held, kept = [], 0
        if made >= BLOCK_BYTES // 4 and out:
            yield out
            out, made = [], 0
    used = close(out, held, used)
    if out:
        yield out


def _encoded(it: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    encode, end = byte_tokens(path).encode, np.array([END], "<u4").tobytes()
    for batch in batches(it, 1000):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc, encode(text) + end
    byte_tokens(path).forget()  # the worker lives on and runs other stages
    give_back()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), see PIECES."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for pieces in pack_rows(_encoded(it, path)):
            for at in range(0, len(pieces), SENT):
                d, s, n, b, t, q, o = zip(*pieces[at : at + SENT], strict=True)
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([long(d), long(s), long(n), pa.array(b, pa.binary()), long(t), long([base + x for x in q]), long(o)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, ids): the assembled sequences, padded with zeros to `size` unless their length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(size - F.col("n_tokens")).cast("int")
    return whole.select("sequence_id", "n_tokens", F.concat(joined, F.unhex(F.repeat(F.lit("00000000"), pad))).alias("ids"))
