"""Sources: page tables, JSON lines, batch files, text files, HTML links. Fetching is left to the caller; parsing is here."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_no int, text string, char_count int, ocr_used boolean, quality_score double, section_title string, extraction_method string, extraction_error string"
FILING_SCHEMA = "market string, symbol string, company_name string, title string, publish_time string, document_type string, source string, detail_url string, pdf_url string, raw_id string, category string, file_size_label string"
BATCH_SCHEMA = "market string, symbol string, company_name string, document_type string, report_year int, language string, hkex_stock_id string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are no rows, a missing path gives an empty result."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def pages_jsonl(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """Pages of one document, with defaults for what is missing."""
    rows = jsonl(spark, path, PAGE_SCHEMA)
    return rows.select(F.lit(document_id).alias("document_id"), F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("char_count", F.length(F.coalesce("text", F.lit("")))).alias("char_count"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), "quality_score", "section_title", "extraction_method", "extraction_error")


def batch_items(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests by the ending of the path: .csv with a header, .jsonl, or .json holding a list or {"items": [...]}; ValueError for others."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "csv":
        return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if end == "jsonl":
        return jsonl(spark, path, BATCH_SCHEMA)
    if end == "json":
        whole = spark.read.option("multiLine", True).json(path)
        if "items" in whole.columns:
            return whole.select(F.explode("items").alias("i")).select("i.*")
        return whole
    raise ValueError(f"no reader for {path}")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each text file as a document of one page."""
    files = spark.read.option("wholetext", True).text(path).withColumn("document_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.select("document_id", F.lit(1).alias("page_no"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of raw files, read recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def page_range(pages: DataFrame, document_id: str, numbers: list[int] | None = None, limit: int = 20) -> DataFrame:
    """Stated pages of a document in order, or its first ones."""
    rows = pages.where(F.col("document_id") == document_id)
    return rows.where(F.col("page_no").isin(numbers)).orderBy("page_no") if numbers else rows.orderBy("page_no").limit(limit)


def links(html: Column) -> Column:
    """array<struct<pos, href, label>> of the anchors of a page, in order."""
    pattern = r"(?is)<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)[\"']?[^>]*>(.*?)</a>"
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))
    labels = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(2))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    return F.transform(F.arrays_zip(hrefs.alias("h"), labels.alias("l")), lambda x, i: F.struct(i.alias("pos"), x["h"].alias("href"), clean(x["l"]).alias("label")))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href): each address once for a page, at its first place."""
    each = pages.select(key, F.explode(links(F.col(html))).alias("a")).select(key, "a.pos", "a.href").where("href <> ''")
    return each.groupBy(key, "href").agg(F.min("pos").alias("pos"))


def whitelisted(url: Column, hosts: tuple[str, ...]) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin(*hosts), F.lit(False))


def unpivot_profile(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, item, value) for every other column of a profile row."""
    return rows.unpivot(key, [c for c in rows.columns if c not in key], "item", "value")


def latest_group(rows: DataFrame, group: list[str], date: str) -> DataFrame:
    """Rows of the latest date of each group."""
    return rows.withColumn("_last", F.max(date).over(Window.partitionBy(*group))).where(F.col(date) == F.col("_last")).drop("_last")


def limited(rows: DataFrame, most: int, order: list[Column]) -> tuple[DataFrame, dict]:
    """The first rows in a total order, with returned_rows and whether there were more; one row more than asked is looked at for that, never all."""
    some = min(most + 1, rows.limit(most + 1).count())
    return rows.orderBy(*order).limit(most), {"returned_rows": min(some, most), "truncated": some > most}


def statements(parts: dict[str, DataFrame], asked: str) -> DataFrame:
    """The statement asked, or all of them, each row with the name of its statement; ValueError for an unknown one."""
    if asked != "all" and asked not in parts:
        raise ValueError(f"no statement {asked}")
    out = None
    for name, rows in parts.items():
        if asked in (name, "all"):
            named = rows.select(F.lit(name).alias("statement"), "*")
            out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


# --- paged text files and the tables in their pages -----------------------------------------------------------------------
def paged_files(spark: SparkSession, path: str, pages: list[int] | None = None, pattern: str = "*.txt") -> DataFrame:
    """(document_id, page_no, text, status, error): text files whose pages end in form feeds, as page extractors write them.

    The document is the file, by its path below `path`. Only the pages asked for are made rows; without a list, all. A file that is
    no UTF-8 gives one row with status failed, instead of being lost or read with wrong letters; an empty one has no pages.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    body, good = F.col("content").cast("string"), F.is_valid_utf8(F.col("content").cast("string"))
    cut = F.split(F.when(good, F.regexp_replace(body, "\f$", "")), "\f")
    numbered = F.transform(cut, lambda t, i: F.struct((i + 1).cast("long").alias("page_no"), t.alias("text"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
    if pages is not None:
        numbered = F.filter(numbered, lambda p: p["page_no"].isin(pages))
    failed = F.array(F.struct(F.lit(None).cast("long").alias("page_no"), F.lit(None).cast("string").alias("text"), F.lit("failed").alias("status"), F.lit("not UTF-8").alias("error")))
    rows = F.when(~good, failed).when(F.length("content") > 0, numbered)
    root = path.split(":")[-1].rstrip("/")
    name = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root) + "/", "")
    return files.select(name.alias("document_id"), F.explode(rows).alias("p")).select("document_id", "p.*")


def text_tables(pages: DataFrame, keys: tuple[str, ...] = ("document_id", "page_no"), mark: str = "|") -> DataFrame:
    """(keys, table_index, cells): the tables of each page, two or more lines in a row whose cells are parted by `mark`. cells is an array of rows; a mark at either end of a line parts nothing."""
    lines = pages.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("_at", "_line")).where(F.col("_line").contains(mark))
    bare = F.regexp_replace("_line", rf"^\s*{re.escape(mark)}|{re.escape(mark)}\s*$", "")
    cells = F.transform(F.split(bare, re.escape(mark)), lambda c: F.trim(c))
    run = F.col("_at") - F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    rows = lines.select(*keys, "_at", cells.alias("_cells"), run.alias("_run"))
    tables = rows.groupBy(*keys, "_run").agg(F.min("_at").alias("_first"), F.sort_array(F.collect_list(F.struct("_at", "_cells"))).alias("_rows")).where(F.size("_rows") >= 2)
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    return tables.select(*keys, index.alias("table_index"), F.transform("_rows", lambda r: r["_cells"]).alias("cells"))
