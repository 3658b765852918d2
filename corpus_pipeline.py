"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns documents with the same
columns; the last returns the packed pieces. Between stages the rows are written and read again, so that a lost executor costs one
stage at most; a stage's table goes as soon as the next one is written.

Defined cases, for every stage: a row is known by its id and its text together, so a repeated or null id never takes an
unrelated row with it; null text counts as empty; very long texts are read whole; of rows equal in id and text that a dedup
stage keeps, one stays; an empty table stays empty; further columns may have any names, and are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import exact_dedup, near_dedup, packing, pii, quality
from paperweave.llm.common import discard, drop_rows, join_heavy, materialize, may_survive, one_of_each, row_columns, survivor_bits, table, whole_row
from paperweave.llm.queries import BYTE_BPE
from paperweave.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def _row() -> Column:
    """A row by its id, which can be null or repeated, and its text (null counts as empty)."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the largest id, any id before a null one."""
    found = exact_dedup.exact_duplicates(docs, carry={"_row": _row()}).where("group_size > 1")
    found = materialize(found.groupBy("_row").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).withColumnRenamed("_row", "_key"), "copies")
    left = drop_rows(docs, found.where("not kept"), _row())
    return one_of_each(left, found.where("kept and n > 1"), _row())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, any id before a null or repeated one."""
    numbered, again = _numbered(docs)
    found = near_dedup.near_duplicates(numbered.select("number", "row.text"), "number")
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("_key")), "dropped")
    left = drop_rows(numbered, dropped, F.col("number")).select(*row_columns(docs.columns))
    return one_of_each(left, again, _row())


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, number), the number being the id where no other row has it, else one from id and text above 2^62, so that ids in use come first; and the keys of rows that repeat both id and text, a written table."""
    wide = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), _row().alias("_key"))
    many = materialize(wide.groupBy("id").agg(F.count("*").alias("n"), F.lit(True).alias("_again")).where("id is null or n > 1"), "repeated")
    if many.isEmpty():  # all ids are there and differ
        return wide.select("row", F.col("id").alias("number")), many.select(F.struct("id", "id").alias("_key"))
    flagged = may_survive(wide.where("id is not null"), survivor_bits(many, "id"), "id", "_suspect")
    rows_of_many = many.agg(F.sum("n")).first()[0]
    suspects = join_heavy(flagged.where("_suspect"), many.where("id is not null"), "id", "n", rows_of_many, "left").select("row", "id", "_key", F.coalesce("_again", F.lit(False)).alias("_again"))
    suspects = suspects.unionByName(wide.where("id is null").withColumn("_again", F.lit(True)))
    again = materialize(suspects.where("_again").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "repeated")
    other = F.lit(1 << 62) + F.xxhash64("_key").bitwiseAND(F.lit((1 << 62) - 1))
    plain = flagged.where("not _suspect").select("row", F.col("id").alias("number"))
    return plain.unionByName(suspects.select("row", F.when(F.col("_again"), other).otherwise(F.col("id")).alias("number"))), again


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL cannot express tokenisation; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(ship(spark), sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
