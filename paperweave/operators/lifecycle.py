"""Keyed tables over time: upserts, caches with a time to live, batches, audits, clean-ups. All take and return rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of


def blank_safe(keys: list[str], side: str = "") -> list[Column]:
    """Keys that treat null and the empty text alike."""
    return [F.coalesce(F.col(f"{side}{k}").cast("string"), F.lit("")) for k in keys]


def latest(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order; unlike dropDuplicates, always the same one."""
    return latest(rows, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the columns that new has are changed, for keys that it has; keys not yet there are added."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    there = F.col(f"b.{keys[0]}").isNotNull()
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")).alias(c) for c in old.columns if c not in keys])


def replace_null_safe(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new has go, then all of new comes; null equals the empty text."""
    gone = new.select(*[c.alias(f"_{k}") for k, c in zip(keys, blank_safe(keys), strict=True)]).distinct()
    on = [c == F.col(f"_{k}") for k, c in zip(keys, blank_safe(keys), strict=True)]
    return old.join(gone, on, "left_anti").unionByName(new)


def source_key(source: Column, *ids: Column) -> Column:
    """Source and the first id that is not blank."""
    return F.concat_ws("|", F.lower(text_of(source)), F.coalesce(*[F.nullif(text_of(i), F.lit("")) for i in ids], F.lit("")))


def merge_sources(seen: DataFrame, key: str, time: str, keep_first: list[str], keep_last: list[str]) -> DataFrame:
    """One row for each key: first and last time seen, some values as first given, others as last given. Of rows of one time the values that sort first count as first, those that sort last as last."""
    first, last = (F.struct(time, *names) for names in (keep_first, keep_last))
    out = seen.groupBy(key).agg(F.min(time).alias("first_seen_at"), F.max(time).alias("last_seen_at"), F.count("*").alias("times_seen"), F.min(first).alias("_first"), F.max(last).alias("_last"))
    return out.select(key, "first_seen_at", "last_seen_at", "times_seen", *[F.col(f"_first.{c}").alias(c) for c in keep_first], *[F.col(f"_last.{c}").alias(c) for c in keep_last])


def freshness(now: Column, fetched: Column, expires: Column, max_age_seconds: int | None = None) -> Column:
    """hit or stale; ages count with their parts of a second."""
    stale = now > expires
    if max_age_seconds is not None:
        stale = stale | (now > fetched + F.make_dt_interval(secs=F.lit(max_age_seconds).cast("decimal(18,6)")))
    return F.when(stale, "stale").otherwise("hit")


def _hashed(rows: DataFrame, content: str, digest: Column) -> DataFrame:
    """Rows whose size occurs twice, with their digest; the size is taken from the content itself, null as empty."""
    sized = rows.withColumn("_size", F.length(F.coalesce(F.col(content), F.lit(""))))
    sizes = sized.groupBy("_size").agg(F.count("*").alias("_n")).where("_n > 1").select("_size")
    return sized.join(sizes, "_size", "left_semi").select(*[c for c in rows.columns if c != content], digest.alias("digest"))


def duplicates(rows: DataFrame, content: str, digest: Column, name: str, least: str) -> DataFrame:
    """Groups of equal content with the list of their members and the least value of one column: only rows whose size occurs twice are hashed. digest is evaluated for those alone."""
    return _hashed(rows, content, digest).groupBy("digest").agg(F.count("*").alias("n"), F.min(least).alias(least), F.sort_array(F.collect_list(name)).alias("members")).where("n > 1")


def duplicate_rows(rows: DataFrame, content: str, digest: Column, name: str) -> DataFrame:
    """(name, digest, n, first), one row for each member of a group, for groups of any size: no list of members is made."""
    hashed = _hashed(rows.select(name, content), content, digest)
    groups = hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min(name).alias("first")).where("n > 1").withColumnRenamed("digest", "_digest")
    return hashed.join(groups, F.col("digest").eqNullSafe(F.col("_digest"))).drop("_digest")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the keys that go, and how many rows of each went."""
    rest = {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        one = t.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(n).alias("table_name"), "n_deleted")
        counts = one if counts is None else counts.unionByName(one)
    return rest, counts


def consistency(documents: DataFrame, parts: dict[str, DataFrame], key: str, declared: str) -> DataFrame:
    """Declared and found counts for each document, and whether all agree."""
    out = documents.select(key, F.col(declared).alias("declared"))
    for name, part in parts.items():
        out = out.join(part.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    agree = F.lit(True)
    for name in parts:
        agree = agree & (F.col(name) == F.col("declared"))
    return out.withColumn("consistent", agree)


def batch_plan(items: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Each row with the row whose work it shares (null for the first of its key): same key, same work."""
    lead = F.min(row).over(Window.partitionBy(*blank_safe(keys)))
    return items.withColumn("deduplicated_from_row", F.when(lead != F.col(row), lead))


def batch_summary(results: DataFrame, status: str) -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n"), F.count("deduplicated_from_row").alias("n_deduplicated"))


def resume(items: DataFrame, done: DataFrame, row: str) -> DataFrame:
    """Items not yet done."""
    return items.join(done.select(row), row, "left_anti")


def unreferenced(files: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """Files that no table refers to."""
    every = references[0].select(key)
    for r in references[1:]:
        every = every.unionByName(r.select(key))
    return files.join(every.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def shared_references(tables: list[DataFrame], path: str, owner: str) -> DataFrame:
    """Paths that more than one owner refers to, with the owners."""
    every = tables[0].select(path, owner)
    for t in tables[1:]:
        every = every.unionByName(t.select(path, owner))
    return every.groupBy(path).agg(F.count("*").alias("n_references"), F.countDistinct(owner).alias("n_owners"), F.min(owner).alias("first_owner")).where("n_owners > 1")


def ingest_status(known: Column, stored: Column, actual: Column, forced: Column, readable: Column) -> Column:
    return (
        F.when(~known, "miss").when(forced, "forced_overwrite").when(~readable, "corrupt_cache").when(F.coalesce(stored, F.lit("")) == "", "stale_missing_hash")
        .when(stored != actual, "stale_hash_mismatch").otherwise("hit")
    )


def fallback(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the rows of the first branch that has any."""
    every = None
    for i, b in enumerate(branches):
        b = b.withColumn("branch", F.lit(i))
        every = b if every is None else every.unionByName(b)
    least = every.groupBy(*keys).agg(F.min("branch").alias("branch"))
    return every.join(least, [*keys, "branch"], "left_semi")


def override(cached: DataFrame, linked: DataFrame, key: str, fields: list[str], order: list[str] | None = None) -> DataFrame:
    """Cached rows, with each field that the linked row of the same key gives and that is not blank; of several linked rows the last by `order` counts, ties by the fields themselves."""
    last = linked.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*(order or []), *[F.col(f).alias(f"_{f}") for f in fields])).alias("_b"))
    b = last.select("_key", *[F.col(f"_b._{f}") for f in fields])
    return cached.join(b, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in cached.columns])
