"""Token shards in training order: a keyed Feistel permutation with cycle-walking gives every sequence a global slot.

1. Documents are tokenised and packed in their partitions, and the sequences are written, compressed, to the shared folder: a lost
   executor never makes a partition tokenise anew, in another order of rows, what is numbered already. Where the caller states
   that docs are `stable`, a plain scan of written files, whose partitions hold the same rows in the same order each time, they
   are kept by the executors instead, which saves a copy on disk; what a lost executor held is made again, and is the same.
2. Partition sizes give every sequence a dense index; the permutation maps 0..N-1 onto itself, so slots are dense as well.
3. Each partition of the second stage owns a range of slots, sorts it and writes whole shards of a fixed stride, each under a
   temporary name first. A shard that a lost executor leaves behind is written anew with the same bytes, so reads resume at
   any slot: shard = slot // shard_sequences, byte = slot % shard_sequences * STRIDE.

A record is LENGTH ids of 16 bits, little-endian, padded with the end id.

Defined cases: null or empty text is the end id alone; a very long text is cut into full sequences; equal lengths are placed in
order of rows; repeated rows and rows with a null id are written each; an empty table writes nothing; other columns are dropped,
whatever their names. An id of 65,536 or more is a ValueError.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import discard, materialize
from .packing import LENGTH, _encoded, pack_rows
from .wordhash import mix

WIDTH = 2
STRIDE = LENGTH * WIDTH
#: 16,384 sequences of 2 KB are 32 MB.
SHARD_SEQUENCES = 16_384
MOST_TASKS = 20_000
ROUNDS = 6
MANIFEST = "slot long, shard long, byte_offset long, n_tokens long, n_pieces long, ids_crc32 long"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: balanced Feistel rounds on the next even number of bits, repeated until the value is below n."""
    if n <= 1:
        return index.astype(np.int64)
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & (1 << 63) - 1))
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as ids of 16 bits."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"id {wide.max()} needs more than 16 bits")
    return wide.astype("<u2").tobytes()


def _records(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for pieces in pack_rows(((d, narrow(b)) for d, b in _encoded(it, path)), width=WIDTH):
            pieces.sort(key=lambda x: (x[5], x[6]))
            rows: list[tuple[bytes, int, int]] = []
            last = None
            for _, _, n, ids, _, sequence, _ in pieces:
                if sequence == last:
                    b, t, k = rows[-1]
                    rows[-1] = (b + ids, t + n, k + 1)
                else:
                    rows.append((ids, n, 1))
                last = sequence
            for at in range(0, len(rows), 2000):
                b, t, k = zip(*rows[at : at + 2000], strict=True)
                b, size = [squeeze(x) for x in b], len(b)
                yield pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int32()), pa.array(range(local, local + size), pa.int64()), pa.array(t, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["part", "local", "n_tokens", "n_pieces", "tokens"])
                local += size

    return run


def _writer(target: str, shard_sequences: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        shard, out, name, attempt = -1, None, "", TaskContext.get().taskAttemptId()
        expand = zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")

        for batch in it:
            slots, tokens = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            crc = []
            for slot, ids in zip(slots, tokens, strict=True):
                if slot // shard_sequences != shard:
                    close()
                    shard = slot // shard_sequences
                    name = f"shard-{shard:08d}.bin"
                    out = store.open_output_stream(f"{root}/.{name}-{attempt}")
                record = expand(ids).ljust(STRIDE, b"\0")
                out.write(record)
                crc.append(zlib.crc32(record))
            at = np.array(slots, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(at // shard_sequences), pa.array(at % shard_sequences * STRIDE), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(crc, pa.int64())], names=["slot", "shard", "byte_offset", "n_tokens", "n_pieces", "ids_crc32"])
        close()

    return run


def write_shards(docs: DataFrame, path: str, target: str | None = None, key: int = 20240607, shard_sequences: int = SHARD_SEQUENCES, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> tuple[str, DataFrame]:
    """Writes the shards and returns their folder and the manifest, one row for each sequence."""
    spark = docs.sparkSession
    target = target or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    target = target if "://" in target or target.startswith("file:") else f"file://{target}"
    store, root = fs.FileSystem.from_uri(target)
    store.create_dir(root)
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_records(path), "part int, local long, n_tokens int, n_pieces int, tokens binary")
    rows = packed.persist(StorageLevel.MEMORY_AND_DISK) if stable else materialize(packed, "sequences")
    # One number for each partition, however large the input.
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n, base = 0, {}
    for part in sorted(sizes):
        base[part], n = n, n + sizes[part]
    if not n:
        return target, spark.createDataFrame([], MANIFEST)
    starts = spark.createDataFrame(list(base.items()), "part int, base long")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(np.int64), n, key))

    shards = -(-n // shard_sequences)
    tasks = min(shards, MOST_TASKS)
    placed = rows.join(F.broadcast(starts), "part").select(slot(F.col("base") + F.col("local")).alias("slot"), "n_tokens", "n_pieces", "tokens")
    owner = (F.floor(F.col("slot") / shard_sequences) * tasks / shards).cast("int")
    ranged = placed.repartitionById(tasks, owner).sortWithinPartitions("slot")
    manifest = materialize(ranged.mapInArrow(_writer(target, shard_sequences), MANIFEST), "manifest")
    if stable:
        rows.unpersist()
    else:
        discard(rows)
    return target, manifest


def read_slots(target: str, start: int, count: int, shard_sequences: int = SHARD_SEQUENCES) -> np.ndarray:
    """Records start..start+count-1 in training order, by seeking: a (count, LENGTH) array of ids, shorter at the end of the data."""
    store, root = fs.FileSystem.from_uri(target)
    out = []
    while count > 0:
        shard, at = divmod(start, shard_sequences)
        name = f"{root}/shard-{shard:08d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break
        with store.open_input_file(name) as f:
            f.seek(at * STRIDE)
            data = f.read(min(count, shard_sequences - at) * STRIDE)
        got = len(data) // STRIDE
        if not got:
            break
        out.append(np.frombuffer(data, "<u2").reshape(got, LENGTH))
        start, count = start + got, count - got
    return np.concatenate(out) if out else np.zeros((0, LENGTH), np.uint16)
