"""Selection of filings, caches of source queries, batches and audits. All take and return rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filings as rules
from ..functions.text import text_of


def search_sources(rows: DataFrame, market: str, limit: int, order: list[Column], symbol: str | None = None, within: list[str] | None = None, **equal: object) -> DataFrame:
    """Active rows of a market (case does not count), of a symbol and of further stated values, the first `limit` in a total order, of all or of each group."""
    found = rows.where(F.upper("market") == market.upper())
    for name, value in {"symbol": symbol, **equal}.items():
        if value is not None:
            found = found.where(F.col(name) == value)
    if "status" in rows.columns:
        found = found.where(F.coalesce("status", F.lit("active")) == "active")
    if within is None:
        return found.orderBy(*order).limit(limit)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def documents_of(documents: DataFrame, companies: DataFrame, order: list[Column]) -> DataFrame:
    """Documents of the companies (market, symbol) with their place, the last created first."""
    of = companies.select(F.upper("market").alias("_market"), F.col("symbol").alias("_symbol")).distinct()
    found = documents.join(of, (F.upper("market") == F.col("_market")) & (F.col("symbol") == F.col("_symbol")), "left_semi")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("market", "symbol").orderBy(*order)))


def any_column(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of which any column, as trimmed upper-case text, is one of the targets."""
    cells = F.array(*[F.upper(F.trim(F.col(c).cast("string"))) for c in rows.columns])
    return rows.where(F.exists(cells, lambda c: c.isin(*targets)))


def cached_document(documents: DataFrame, page_counts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each request (request_id, market, symbol, document_type, language, and year or null) the ready document of the latest year and time: its hash is the file's, and as many pages are indexed as it declares."""
    ready = documents.join(page_counts, "document_id", "left").where((F.col("sha256") == F.col("file_sha256")) & ((F.coalesce("page_count", F.lit(0)) == 0) | (F.col("page_count") == F.coalesce("indexed", F.lit(0)))))
    both = asked.join(ready, ["market", "symbol", "document_type", "language"]).where(F.col("year").isNull() | (F.col("year") == F.col("report_year")))
    over = Window.partitionBy("request_id").orderBy(F.desc("report_year"), F.desc("publish_time"), "document_id")
    return both.withColumn("_n", F.row_number().over(over)).where("_n = 1").select("request_id", "document_id", "report_year")


def first_hits(found: DataFrame, group: list[str], keyword: str, url: str, stops: Column, order: list[Column]) -> DataFrame:
    """Results of several keywords in turn: each address once, at its first keyword, up to the first keyword with a result that ends the search; then in a total order, with `place`."""
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy(*group, url).orderBy(keyword, *order))).where("_n = 1").drop("_n")
    last = F.min(F.when(stops, F.col(keyword))).over(Window.partitionBy(*group))
    kept = once.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(keyword) <= F.col("_last"))).drop("_last")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order, keyword, url)))


def put_queries(cache: DataFrame, answers: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """cache with the answers in it: one row for each signature, lists without a result too. Columns: query_signature, fetched_at, expires_at, result_count, records."""
    new = answers.select("query_signature", now.alias("fetched_at"), F.timestamp_add("SECOND", F.greatest(F.lit(0), ttl_seconds), now).alias("expires_at"), F.size("records").cast("long").alias("result_count"), "records")
    return cache.join(new.select("query_signature"), "query_signature", "left_anti").unionByName(new)


def usable_entry(entries: DataFrame, asked_rows: int, stale: bool = False) -> DataFrame:
    """For each request the entry to answer from: the first by rank that has enough records, or fewer than its own fetch limit and so all there are; of stale ones that with most records. entries: request_id, rank, n_records, fetch_limit."""
    if stale:
        order, some = [F.desc("n_records"), F.col("rank")], entries
    else:
        order, some = [F.col("rank")], entries.where((F.col("n_records") >= asked_rows) | (F.col("n_records") < F.col("fetch_limit")))
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where("_n = 1").select("request_id", "rank", F.least(F.col("n_records"), F.lit(asked_rows).cast("long")).alias("n_used"))


def mapped(rows: DataFrame, codes: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """rows with `column` replaced by its new code where the table of codes has one."""
    one = codes.groupBy(F.col(old).alias("_old")).agg(F.min(new).alias("_new"))
    return rows.join(one, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def resolved(rows: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """value from the first of the named sources (key, value) that has the key, and the name of that source; not_found where none has."""
    out, found, name = rows, [], None
    for i, (label, source) in enumerate(sources):
        one = source.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_v{i}"))
        name = (F if name is None else name).when(F.col(f"_v{i}").isNotNull(), label)
    return out.withColumns({value: F.coalesce(*found), "resolved_by": name.otherwise("not_found")}).drop(*[f"_v{i}" for i in range(len(sources))])


def batch_items(items: DataFrame) -> DataFrame:
    """Requests in normal form, with `problem` where one cannot be run."""
    t = lambda c: F.trim(text_of(F.col(c)))
    market, kind = F.upper(t("market")), F.coalesce(F.nullif(F.lower(t("document_type")), F.lit("")), F.lit("annual_report"))
    problem = F.when(~market.isin("A", "H"), "market must be A or H").when(t("symbol") == "", "symbol is required").when(~kind.isin("annual_report", "prospectus"), "document_type must be annual_report or prospectus")
    lang = F.coalesce(F.nullif(F.upper(t("language")), F.lit("")), F.when(market == "H", "EN").otherwise("ZH"))
    return items.select("row_no", market.alias("market"), t("symbol").alias("symbol"), kind.alias("document_type"), t("report_year").try_cast("int").alias("report_year"), lang.alias("language"), problem.alias("problem"))


def run_status(ok: Column, cache_hit: Column, dispositions: Column) -> Column:
    """cached, accepted, needs_review or failed."""
    return F.when(ok & F.coalesce(cache_hit, F.lit(False)), "cached").when(ok, "accepted").when(F.array_contains(dispositions, "needs_review"), "needs_review").otherwise("failed")


def audit(files: DataFrame, documents: DataFrame, references: list[DataFrame], path: str = "path") -> DataFrame:
    """(metric, n): files, their bytes, those that no table refers to, copies beyond the first of equal content, documents whose file is gone, and those whose hash is not the file's. files: path, length, sha256; documents: document_id, path, sha256."""
    every = documents.select(path)
    for r in references:
        every = every.unionByName(r.select(path))
    orphans = files.join(every.where(F.col(path).isNotNull()).distinct(), path, "left_anti")
    copies = files.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    known = documents.where(F.col(path).isNotNull()).join(files.select(path, F.col("sha256").alias("_file")), path, "left")
    one = lambda name, df, n=F.count("*"): df.agg(F.coalesce(n.cast("long"), F.lit(0)).alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [
        one("files", files), one("bytes", files, F.sum("length")), one("unreferenced_files", orphans), one("redundant_copies", copies, F.sum(F.col("n") - 1)), one("duplicate_groups", copies),
        one("documents", documents), one("missing_files", known.where(F.col("_file").isNull())), one("hash_mismatches", known.where(F.col("_file") != F.col("sha256"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete_company(tables: dict[str, DataFrame], queries: DataFrame, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table and the query cache without the companies (market, symbol) of gone, and how many rows of each went. A cached query belongs to the company in its signature's JSON."""
    key = gone.select("market", "symbol").distinct()
    body = F.regexp_replace("query_signature", r"^[^|]*\|", "")
    cached = queries.withColumns({"market": F.get_json_object(body, "$.market"), "symbol": F.get_json_object(body, "$.symbol")})
    every = {**tables, "source_queries": cached}
    rest = {n: t.join(key, ["market", "symbol"], "left_anti").select(*t.columns) for n, t in every.items()}
    rest["source_queries"] = rest["source_queries"].drop("market", "symbol")
    counts = None
    for n, t in every.items():
        one = t.join(key, ["market", "symbol"], "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(n).alias("table_name"), "n_deleted")
        counts = one if counts is None else counts.unionByName(one)
    return rest, counts


def replace_page(pages: DataFrame, new: DataFrame) -> DataFrame:
    """pages with those of new in place of the same pages."""
    return pages.join(new.select("document_id", "page_no"), ["document_id", "page_no"], "left_anti").unionByName(new.select(pages.columns))


def replace_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """Table rows of the documents in new replaced by those of new that have a path; flags that are no JSON list become one flag saying so."""
    flags = F.from_json("quality_flags_json", "array<string>")
    kept = new.where(text_of(F.col("table_path")) != "").withColumn("quality_flags", F.when(F.col("quality_flags_json").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(flags, F.array(F.lit("invalid_quality_flags_json")))))
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(kept.select(old.columns))


def link_files(sources: DataFrame, links: DataFrame) -> DataFrame:
    """sources with local_path and document_id of the link that has the same address; of several links the last by name counts."""
    last = links.groupBy(F.col("url").alias("_url")).agg(F.max(F.struct("local_path", "document_id")).alias("_l"))
    wide = sources.join(last, F.col("url") == F.col("_url"), "left")
    return wide.withColumns({c: F.coalesce(F.col(f"_l.{c}"), F.col(c)) for c in ("local_path", "document_id")}).select(sources.columns)


def title_records(pages: DataFrame, base: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Filing records from search pages: each anchor with a title whose address is one of a filing, with the category and size of its own table row. pages: key, html."""
    rows = F.regexp_extract_all(F.regexp_replace(text_of(F.col(html)), r"(?i)<tr\b", "\u0001<tr"), F.lit("(?s)[^\u0001]+"), F.lit(0))
    each = pages.select(key, F.posexplode(rows).alias("row_no", "_row"))
    link = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    of_class = lambda name: F.nullif(plain(F.regexp_extract("_row", rf"""(?is)class\s*=\s*["']?{name}["']?[^>]*>(.*?)</""", 1)), F.lit(""))
    found = each.select(key, "row_no", of_class("headline").alias("category"), of_class("attachment_filesize").alias("file_size_label"), F.posexplode(F.arrays_zip(F.regexp_extract_all("_row", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("_row", F.lit(link), F.lit(2)).alias("label"))).alias("pos", "a"))
    href, title = F.col("a.href"), plain(F.col("a.label"))
    wanted = F.lower(href).rlike(r"/listedco/|/newlistings/|/news/|\.(pdf|html?|xlsx?)$") & (title != "")
    url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(base), F.regexp_replace(href, "^/*", "/")))
    return found.where(wanted).select(key, "row_no", "pos", title.alias("title"), url.alias("url"), "category", "file_size_label", F.when(F.lower(url).endswith(".pdf"), url).alias("pdf_url"))


def register_rows(rows: DataFrame, name: str | None, status: str | None, aliases: dict[str, list[str]], order: list[Column], most: int) -> DataFrame:
    """Rows of a listing register under common names (the first alias present and not blank), whose name and status contain those asked, whatever the case; the first `most` in a total order."""
    named = rows.select(*[rules.first_present(*[F.col(a) for a in of if a in rows.columns]).alias(c) for c, of in aliases.items()])
    for column, part in (("company_name", name), ("status", status)):
        if part:
            named = named.where(F.lower(text_of(F.col(column))).contains(part.lower()))
    return named.orderBy(*order).limit(most)
