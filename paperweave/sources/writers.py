"""Sinks. Spark's commit protocol makes each write whole or void."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def table_csv(cells: DataFrame, path: str) -> None:
    """All values quoted, null as the empty text."""
    cells.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cells.columns]).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def replace_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """All pages of the documents in new are replaced by those given; pages below 1 are no pages, of equal numbers the last given (by `order`, if there is one, then by text) counts."""
    order = [F.desc("order")] if "order" in new.columns else []
    last = new.where("page_no > 0").withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "page_no").orderBy(*order, F.desc("text")))).where("_n = 1")
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(last.select(old.columns))


def full_text(rows: DataFrame, markers: bool = False) -> DataFrame:
    """(document_id, full_text): pages in order, joined by an empty line; with markers each begins with its number."""
    text = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit("<!-- page: "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), text) if markers else text
    ordered = F.sort_array(F.collect_list(F.struct("page_no", body.alias("t"))))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("full_text"))
