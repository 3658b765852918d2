"""Exact duplicates by progressive refinement, with DataFrame functions only.

1. Rows are grouped by length and by a hash of the first characters; one narrow pass gives both, since a column file has no
   cheaper way to a length than to the text. Groups of one row are settled here.
2. The groups that survive go into a bitmap of fixed size, which is broadcast: the second pass hashes the full content of
   their rows only. Nothing but short keys is ever shuffled, counts are combined before the shuffle, and the largest groups
   (at most MOST_HEAVY of them) meet their rows by broadcast, so a group that holds a third of all rows stays spread out.

Defined cases: null counts as the empty text; a very long text is read once and only its hash is kept; of equal texts the row
with the largest id stays; rows that repeat that id as well all count as the row that stays; a null id never wins over
another; an empty table gives an empty result; other columns are ignored unless carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize, may_survive, survivor_bits

PREFIX = 128
#: 2 MB of bitmap. With more surviving groups than bits all rows are hashed in full; results do not change.
BITS = 1 << 24


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) and the carried expressions of docs, for every row."""
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.length(text).alias("_length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("_prefix"), *[c.alias(n) for n, c in carry.items()])
    rows = rows.withColumn("_level2", F.xxhash64("_length", "_prefix"))
    shared = rows.groupBy("_length", "_prefix", "_level2").count().where("count > 1").select("_level2")
    flagged = may_survive(rows, survivor_bits(shared, "_level2", BITS), "_level2", "_more", BITS)
    # A row alone with its length and prefix is its own group, so the pair can name it.
    key = F.when(F.col("_more"), F.sha2("_text", 256)).otherwise(F.concat_ws(":", F.col("_length").cast("string"), F.hex("_prefix")))
    keyed = materialize(flagged.select("doc_id", key.alias("_key"), "_more", *carry), "exact")
    groups = keyed.where("_more").groupBy("_key").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    groups = materialize(groups.withColumn("_n", F.col("_size")), "groups")
    joined = join_heavy(keyed, groups, "_key", "_n", keyed.count(), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *carry)
