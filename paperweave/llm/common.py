"""What the operators of this subpackage share: tables, shared storage, bounded row filters, joins with heavy keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bits in one bucket of Spark's bitmap functions (4096 bytes).
BUCKET_BITS = 32768
#: A key is heavy if it has at least this share of all rows; so at most so many keys are heavy, whatever the input.
MOST_HEAVY = 2000
#: Rows that a Python worker is sent at once while a table is written. Both sides of the pipe hold such a batch, and rows here carry whole texts or sets.
ARROW_ROWS = 1000
#: And so many bytes at most, so that many long texts or sets in a row do not fill a worker; one longer row is a batch of its own.
ARROW_BYTES = 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct, so that no name can clash with one of ours."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def row_columns(columns: Iterable[str], row: str = "row") -> list[Column]:
    """The columns of whole_row again."""
    return [F.col(f"{row}.{quoted(c)}").alias(c) for c in columns]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing. The session's own sizes of Arrow batches come back afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows, size = int(spark.conf.get(_ROWS)), spark.conf.get(_BYTES)
    spark.conf.set(_ROWS, str(ARROW_ROWS if rows <= 0 else min(rows, ARROW_ROWS)))
    spark.conf.set(_BYTES, str(ARROW_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, str(rows))
        spark.conf.set(_BYTES, size)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that is made of them has been written itself."""
    for df in tables:
        spark, ours = df.sparkSession, shared_dir(df.sparkSession).split(":")[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if ours in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def survivor_bits(keys: DataFrame, key: str, bits: int = 1 << 22) -> DataFrame:
    """A bitmap of at most `bits` bits over a hash of `key`: rows (bucket, bits), bounded by bits / 8 bytes however many keys there are."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.where(F.col(key).isNotNull()).groupBy((at / BUCKET_BITS).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg((at % BUCKET_BITS).cast("long")).alias("_bits"))


def may_survive(df: DataFrame, bits_df: DataFrame, key: str, flag: str, bits: int = 1 << 22) -> DataFrame:
    """Adds boolean `flag`: false means that the key is surely not among those of bits_df. Never moves the rows: the bitmap has a fixed size and is broadcast. df has no columns named _bucket, _bits or _byte."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = df.withColumn("_bucket", (at / BUCKET_BITS).cast("int")).join(F.broadcast(bits_df), "_bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(pmod(xxhash64({key}), {bits}L) % {BUCKET_BITS} / 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr(f"shiftright(_byte, cast(pmod(xxhash64({key}), {bits}L) % 8 as int)) & 1") == 1
    return joined.withColumn("_byte", byte).withColumn(flag, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_bucket", "_bits", "_byte")


def _suspects(df: DataFrame, keys: DataFrame, key: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(row, key) of the rows that the bitmap of `keys` clears, and of those that it suspects. Only the latter are ever shuffled."""
    flagged = may_survive(df.select(whole_row(df).alias("row"), key.alias(name)), survivor_bits(keys, name), name, "_suspect")
    return flagged.where("not _suspect").drop("_suspect"), flagged.where("_suspect").drop("_suspect")


def drop_rows(df: DataFrame, dropped: DataFrame, key: Column, name: str = "_key") -> DataFrame:
    """df without the rows whose key is in the column `name` of dropped, a written table; a null key stays. The columns of df may have any names."""
    if dropped.isEmpty():
        return df
    clean, suspects = _suspects(df, dropped, key, name)
    suspects = suspects.join(dropped.select(name).distinct(), name, "left_anti")
    return clean.select("row").unionByName(suspects.select("row")).select(*row_columns(df.columns))


def one_of_each(df: DataFrame, repeated: DataFrame, key: Column, name: str = "_key") -> DataFrame:
    """df with one row of each key that is in the column `name` of repeated, a written table, and all rows of other keys. Repeats are combined in each task before the shuffle."""
    if repeated.isEmpty():
        return df
    clean, suspects = _suspects(df, repeated, key, name)
    again = suspects.join(repeated.select(name, F.lit(True).alias("_again")).distinct(), name, "left")
    once = again.where("_again").groupBy(name).agg(F.first("row").alias("row"))
    return clean.select("row").unionByName(again.where("_again is null").select("row")).unionByName(once.select("row")).select(*row_columns(df.columns))


def join_heavy(many: DataFrame, one: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """many joined with one, which has each key once and in column `n` how many rows of many have it (dropped here). Heavy keys, at most MOST_HEAVY, are broadcast; so no key with more than that share of the rows is ever dealt to one task."""
    least = max(2, -(-total // MOST_HEAVY))
    heavy, light = one.where(F.col(n) >= least).drop(n).withColumn("_heavy", F.lit(True)), one.where(F.col(n) < least).drop(n)
    met = many.join(F.broadcast(heavy), key, "left")  # both branches use one broadcast
    return met.where("_heavy").drop("_heavy").unionByName(met.where("_heavy is null").select(many.columns).join(light, key, how))
