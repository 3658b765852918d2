"""Clean-ups as rows: what to delete and what to keep, and why, before anything is deleted. A plan is a table; running it twice deletes nothing twice."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of

PLAN = ["document_id", "kind", "path", "action", "reason"]


def path_key(path: Column) -> Column:
    """Paths that differ only in case, repeated or backward slashes are one."""
    return F.lower(F.regexp_replace(F.regexp_replace(text_of(path), r"\\", "/"), "/{2,}", "/"))


def within(path: Column, root: str) -> Column:
    """Below the root, without a step upwards."""
    key = path_key(path)
    return key.startswith(root.lower().rstrip("/") + "/") & ~key.rlike(r"(^|/)\.\.(/|$)")


def _rows(df: DataFrame, kind: str, path: Column, action: Column, reason: Column) -> DataFrame:
    return df.select("document_id", F.lit(kind).alias("kind"), path.alias("path"), action.alias("action"), reason.alias("reason"))


def plan(requested: DataFrame, documents: DataFrame, sources: DataFrame, files: DataFrame, root: str, delete_files: bool = True, delete_parsed: bool = True) -> DataFrame:
    """(PLAN) for the documents of `requested`: their records, raw files and parsed folders.

    documents: document_id, file_path, parsed_path; sources: document_id (can be null), file_path; files: path of all that is there. A raw
    file goes if nobody else refers to it: neither a document that stays, nor a source that belongs to none of those that go. What is
    outside the root or not there is kept, with the reason.
    """
    gone = requested.select("document_id").distinct()
    known = documents.select("document_id", "file_path", "parsed_path")
    mine = gone.join(known, "document_id", "left")
    there = files.select(path_key(F.col("path")).alias("_key"), F.lit(True).alias("_there")).distinct()
    references = known.select("document_id", "file_path").unionByName(sources.select("document_id", "file_path")).where(text_of(F.col("file_path")) != "")
    others = references.join(gone, "document_id", "left_anti").groupBy(path_key(F.col("file_path")).alias("_key")).agg(F.count("*").alias("_others"))

    def judged(rows: DataFrame, column: str, kind: str) -> DataFrame:
        wide = rows.where(text_of(F.col(column)) != "").withColumn("_key", path_key(F.col(column))).join(there, "_key", "left").join(others, "_key", "left")
        reason = F.when(~within(F.col(column), root), "outside the data folder").when(F.col("_others") > 0, "referenced by others").when(F.col("_there").isNull(), "not there")
        return _rows(wide, kind, F.col(column), F.when(reason.isNull(), "delete").otherwise("keep"), reason)

    recorded = F.coalesce(F.col("_known"), F.lit(False))
    records = gone.join(known.select("document_id", F.lit(True).alias("_known")).distinct(), "document_id", "left")
    parts = [_rows(records, "records", F.lit(None).cast("string"), F.when(recorded, "delete").otherwise("keep"), F.when(~recorded, "no record"))]
    if delete_files:
        parts.append(judged(mine.dropDuplicates(["document_id", "file_path"]), "file_path", "file"))
    if delete_parsed:
        parts.append(judged(mine.dropDuplicates(["document_id", "parsed_path"]), "parsed_path", "parsed"))
    return reduce(DataFrame.unionByName, parts)


def reconcile(documents: DataFrame, files: DataFrame, parsed: DataFrame, root: str) -> DataFrame:
    """(PLAN) for what does not fit together: documents without their file, folder or pages lose their records (and a folder without pages); raw files without a document are reported; parsed folders without one go.

    documents: document_id, file_path; files: path of the raw files; parsed: document_id, path, has_pages, one for each parsed folder.
    """
    there = files.select(path_key(F.col("path")).alias("_key"), F.lit(True).alias("_there")).distinct()
    wide = documents.withColumn("_key", path_key(F.col("file_path"))).join(there, "_key", "left").join(parsed.select("document_id", F.col("path").alias("_folder"), "has_pages"), "document_id", "left")
    reason = F.when((text_of(F.col("file_path")) != "") & F.col("_there").isNull(), "file is missing").when(F.col("_folder").isNull(), "folder is missing").when(~F.col("has_pages"), "pages are missing")
    stale = wide.withColumn("_reason", reason).where("_reason is not null")
    empty = stale.where("_folder is not null and not has_pages")
    orphans = parsed.join(documents.select("document_id"), "document_id", "left_anti").withColumn("_in", within(F.col("path"), root))
    loose = files.withColumn("_key", path_key(F.col("path"))).join(documents.select(path_key(F.col("file_path")).alias("_key")).distinct(), "_key", "left_anti")
    return reduce(DataFrame.unionByName, [
        _rows(stale, "records", F.lit(None).cast("string"), F.lit("delete"), F.col("_reason")),
        _rows(empty, "parsed", F.col("_folder"), F.when(within(F.col("_folder"), root), "delete").otherwise("keep"), F.when(within(F.col("_folder"), root), "pages are missing").otherwise("outside the data folder")),
        _rows(orphans, "parsed", F.col("path"), F.when(F.col("_in"), "delete").otherwise("keep"), F.when(F.col("_in"), "no document").otherwise("outside the data folder")),
        _rows(loose.withColumn("document_id", F.lit(None).cast("string")), "file", F.col("path"), F.lit("report"), F.lit("no document")),
    ])


def _delete(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in it:
        done = []
        for path in batch.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            kind = store.get_file_info(at).type
            if kind == fs.FileType.Directory:
                store.delete_dir(at)
            elif kind != fs.FileType.NotFound:
                store.delete_file(at)
            done.append(kind != fs.FileType.NotFound)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], names=["path", "deleted"])


def execute(steps: DataFrame) -> DataFrame:
    """(path, deleted) of the paths that a plan deletes, each once, deleted by the executors; false for what had gone before. Write the plan first: it says what is there, and deleting changes that."""
    return steps.where("action = 'delete' and path is not null").select("path").distinct().mapInArrow(_delete, "path string, deleted boolean")


def remaining(table: DataFrame, steps: DataFrame) -> DataFrame:
    """A table without the records that a plan deletes."""
    return table.join(steps.where("action = 'delete' and kind = 'records'").select("document_id").distinct(), "document_id", "left_anti")


COUNTERS = ("raw_file_count", "hashed_file_count", "indexed_document_count", "duplicate_hash_group_count", "duplicate_logical_name_group_count", "unreferenced_file_count", "missing_indexed_file_count", "staged_file_count", "review_file_count", "content_validated_count", "content_index_reused_count", "content_scanned_count", "content_issue_count")


def logical_name(path: Column) -> Column:
    """A file's name without the hash that tells equal names apart (_ and 8 hexadecimal digits before the ending), whatever the case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(path_key(path), "/"), -1), r"_[0-9a-f]{8}(\.[^.]*)$", "$1"))


def audit(files: DataFrame, documents: DataFrame, sources: DataFrame, validations: DataFrame) -> DataFrame:
    """(metric, n) for COUNTERS. files: path, area (raw, staging, review), length, sha256; documents, sources: file_path; validations: path, reused (pages came from the index), complete, garbled.

    Only raw files whose length occurs twice are hashed, or would have to be: equal lengths come before equal hashes.
    """
    raw = files.where("area = 'raw'").withColumns({"_key": path_key(F.col("path")), "_name": logical_name(F.col("path"))})
    sizes = raw.groupBy("length").agg(F.count("*").alias("_n"), F.count_distinct("sha256").alias("_hashes"))
    keys = documents.select("file_path").unionByName(sources.select("file_path")).where(text_of(F.col("file_path")) != "").select(path_key(F.col("file_path")).alias("_key")).distinct()
    indexed = documents.where(text_of(F.col("file_path")) != "").withColumn("_key", path_key(F.col("file_path")))
    hashes = raw.groupBy("length", "sha256").agg(F.count("*").alias("_n")).where("_n > 1")
    names = raw.groupBy("_name").agg(F.count("*").alias("_n")).where("_n > 1")
    issue = ~F.coalesce("complete", F.lit(False)) | F.coalesce("garbled", F.lit(False))
    one = lambda name, df, n=F.count("*"): df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    counts = [
        one("raw_file_count", raw), one("hashed_file_count", sizes.where("_n > 1"), F.sum("_n")), one("indexed_document_count", documents), one("duplicate_hash_group_count", hashes), one("duplicate_logical_name_group_count", names),
        one("unreferenced_file_count", raw.join(keys, "_key", "left_anti")), one("missing_indexed_file_count", indexed.join(raw.select("_key").distinct(), "_key", "left_anti")),
        one("staged_file_count", files.where("area = 'staging'")), one("review_file_count", files.where("area = 'review'")), one("content_validated_count", validations), one("content_index_reused_count", validations.where("reused")),
        one("content_scanned_count", validations.where("not reused")), one("content_issue_count", validations.where(issue)),
    ]
    return reduce(DataFrame.unionByName, counts)
