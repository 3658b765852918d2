"""Registered queries on requests, filing selection, source caches, batches and audits, each with its SQL. Parts, orders and web pages stand for filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filings as rules
from ..operators import filings
from ..sources import readers
from .queries_search import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _has(hints: tuple[str, ...], of: str) -> str:
    return "(" + " OR ".join(f"contains({of}, '{h}')" for h in hints) + ")"


def _pick(key: str, values: list[str]) -> F.Column:
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, values: list[str]) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST({key} % {len(values)} + 1 AS INTEGER)]"


ASKS = [" Balance Sheet", " cash flow and margin", " 利润表", " financial statements ROE", " list", " P&L"]
_STATEMENT = "CASE " + " ".join(f"WHEN {_has(h, 'q')} THEN '{n}'" for n, h in rules.STATEMENT_HINTS) + " END"


@register(f"WITH t AS (SELECT p_partkey, lower(p_name || {_pick_sql('p_partkey', ASKS)}) AS q FROM part) SELECT p_partkey, {_STATEMENT} AS statement, {_has(rules.INDICATOR_HINTS, 'q')} AS indicators FROM t")
def financial_statement_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", _pick("p_partkey", ASKS)).alias("q"))
    return p.select("p_partkey", rules.requested_statement(F.col("q")).alias("statement"), rules.wants_indicators(F.col("q")).alias("indicators"))


STRATEGIES, TOPICS = ["auto", "basic", "FP&A ", "accounting", "auto", ""], [" revenue recognition", " budget", " operating segments and policy", " coupons", " sales"]


@register(f"""WITH t AS (SELECT p_partkey, lower(p_name || {_pick_sql('p_partkey', TOPICS)}) AS q, coalesce(nullif(lower(trim({_pick_sql('p_partkey', STRATEGIES)})), ''), 'basic') AS s FROM part)
    SELECT p_partkey, CASE WHEN s IN {rules.ACCOUNTING_NAMES} OR (s = 'auto' AND {_has(rules.ACCOUNTING_HINTS, 'q')}) THEN 'accounting_policy' WHEN s IN {rules.FINANCIAL_NAMES} OR (s = 'auto' AND {_has(rules.ANALYSIS_HINTS, 'q')}) THEN 'financial_analysis' ELSE 'basic' END AS strategy FROM t""")
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", rules.strategy(F.concat("p_name", _pick("p_partkey", TOPICS)), _pick("p_partkey", STRATEGIES)).alias("strategy"))


NOTICES = ["Annual Report", "Overseas  Regulatory Announcement", "H-Share Announcement", "年報 海外監管公告", "港股公告"]


@register(rf"""WITH t AS (SELECT page_id, url, {_pick_sql('page_id', NOTICES)} AS title, CASE WHEN page_id % 3 = 0 THEN url || '.pdf' END AS pdf, CASE WHEN page_id % 4 = 1 THEN '' ELSE 'https://www1.hkexnews.hk/' || page_id || '.htm' END AS detail, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error FROM pages),
    k AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS low FROM t)
    SELECT page_id, coalesce(error, '') = '' AND (coalesce(pdf, '') <> '' OR detail <> '') AS valid, coalesce(nullif(pdf, ''), nullif(detail, '')) AS source_url, {_has(rules.OVERSEAS, 'low')} AS overseas, {_has(rules.H_SHARE, 'low')} AS h_share,
        ends_with(detail, '.htm') AND contains(detail, 'hkexnews.hk') AND pdf IS NULL AS package FROM k""")
def candidate_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", _pick("page_id", NOTICES).alias("title"), F.when(k % 3 == 0, F.concat("url", F.lit(".pdf"))).alias("pdf"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("https://www1.hkexnews.hk/"), k.cast("string"), F.lit(".htm"))).alias("detail"), F.when(k % 7 == 0, "timeout").alias("error"))
    pdf, detail, title = F.col("pdf"), F.col("detail"), F.col("title")
    return p.select("page_id", rules.is_candidate(F.col("error"), pdf, detail).alias("valid"), rules.source_url(pdf, detail).alias("source_url"), rules.is_overseas_notice(title).alias("overseas"), rules.is_h_share_notice(title).alias("h_share"), rules.is_listing_package(F.lit("prospectus"), pdf, detail).alias("package"))


TITLES = ["2023 Annual Report", "Annual Report and Accounts 2024", "二零二三年年報", "二〇二四年度報告", "2023 中期年報", "2024 Interim Report", "X2023 Annual Report", "Fiscal Year 2023 Annual Report (revised)", "2024年報摘要"]
SIZES = ["3MB", "900 KB", "1.5 MB", "", "2GB"]


@register(rf"""WITH t AS (SELECT p_partkey, {_pick_sql('p_partkey', TITLES)} AS title, upper({_pick_sql('p_partkey', SIZES)}) AS label, CAST(2023 + p_size % 2 AS VARCHAR) AS y FROM part),
    k AS (SELECT *, translate(y, '0123456789', '零一二三四五六七八九') AS z, regexp_replace(upper(title), '\s+', '', 'g') AS tight, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS low,
        TRY_CAST(nullif(regexp_extract(label, '([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|B)', 1), '') AS DOUBLE) * CASE regexp_extract(label, '([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|B)', 2) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END AS size FROM t)
    SELECT p_partkey, regexp_matches(upper(title), '\b' || y || '\s+ANNUAL\s+REPORT\b') OR regexp_matches(upper(title), '\bANNUAL\s+REPORT(?:\s+AND\s+ACCOUNTS)?\s+' || y || '\b')
            OR ((contains(tight, y) OR contains(tight, z) OR contains(tight, replace(z, '零', '〇'))) AND (contains(tight, '年報') OR contains(tight, '年度報告')) AND NOT (contains(tight, '中期') OR contains(tight, '半年度') OR contains(tight, '季度'))) AS of_year,
        coalesce(size >= 1048576, false) AND NOT {_has(rules.NO_REPORT, 'low')} AND regexp_matches(low, '^(?:fiscal year )?(?:19|20)\d\d annual report(?: and accounts)?(?:\s*\([^)]*\))?$|^annual report(?: and accounts)? (?:19|20)\d\d(?:\s*\([^)]*\))?$') AS sure_en,
        coalesce(size >= 1048576, false) AND NOT {_has(rules.NO_REPORT, 'low')} AND regexp_matches(regexp_replace(title, '\s+', '', 'g'), '^(?:2023|二零二三|二〇二三)(?:年年報|年報|年度報告)$') AS sure_zh FROM k""")
def annual_report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the year asked, and titles that say nothing else."""
    p = table(spark, sf_dir, "part").select("p_partkey", _pick("p_partkey", TITLES).alias("title"), _pick("p_partkey", SIZES).alias("label"), (2023 + F.col("p_size") % 2).alias("y"))
    t, label = F.col("title"), F.col("label")
    return p.select("p_partkey", rules.is_annual_report_of(t, F.col("y")).alias("of_year"), rules.is_sure_annual_report(t, label, "EN").alias("sure_en"), rules.is_sure_annual_report(t, label, "ZH", 2023).alias("sure_zh"))


CATEGORIES = ["Listing Documents - Offer for Subscription", "Listing  Documents", "Formal Notice", "Announcements and Notices", "Circulars", "上市文件"]


@register(rf"""WITH t AS (SELECT p_partkey, p_brand, p_name, p_partkey % 5 AS keyword, trim(regexp_replace(lower({_pick_sql('p_partkey', CATEGORIES)}), '\s+', ' ', 'g')) AS c, p_name || CASE WHEN p_size % 2 = 0 THEN '.pdf' ELSE '.htm' END AS url FROM part),
    r AS (SELECT *, CASE WHEN contains(c, 'listing documents') AND contains(c, 'offer for subscription') THEN 0 WHEN contains(c, 'listing documents') OR contains(c, '上市文件') THEN 1 WHEN contains(c, 'formal notice') OR contains(c, 'announcements and notices') THEN 3 ELSE 2 END AS a,
        CASE WHEN ends_with(url, '.pdf') THEN 0 ELSE 1 END AS b FROM t),
    o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p_brand, url ORDER BY keyword, a, b, p_partkey) = 1),
    k AS (SELECT *, min(keyword) FILTER (a = 0 AND b = 0) OVER (PARTITION BY p_brand) AS last FROM o)
    SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY a, b, p_partkey, keyword, url) AS place FROM k WHERE last IS NULL OR keyword <= last""")
def prospectus_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keywords in turn for each brand: addresses once, until a keyword gives an offering document as PDF; the best first."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 5).alias("keyword"), _pick("p_partkey", CATEGORIES).alias("category"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".pdf").otherwise(".htm")).alias("url"))
    p = p.withColumn("r", rules.prospectus_rank(F.col("category"), F.lit(""), F.col("url")))
    out = filings.first_hits(p, ["p_brand"], "keyword", "url", (F.col("r.category") == 0) & (F.col("r.pdf") == 0), [F.col("r.category"), F.col("r.pdf"), F.col("p_partkey")])
    return out.select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


A_TITLES = ["招股说明书", "2023年年度报告", "2023年年度报告摘要", "首发公告", "增发预案"]


@register(f"WITH t AS (SELECT o_orderkey, {_pick_sql('o_orderkey', A_TITLES)} AS title FROM orders) SELECT o_orderkey, {_has(rules.A_PROSPECTUS, 'title')} AS prospectus, NOT contains(title, '摘要') AND contains(title, '2023') AS report FROM t")
def a_share_title_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pick("o_orderkey", A_TITLES)
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.is_a_prospectus(t).alias("prospectus"), rules.is_whole_annual_report(t, 2023).alias("report"))


@register("SELECT c_custkey, c_nationkey FROM customer WHERE CAST(c_custkey AS VARCHAR) IN ('7', '11') OR CAST(c_nationkey AS VARCHAR) IN ('7', '11') OR upper(trim(c_name)) IN ('7', '11') OR upper(trim(c_mktsegment)) IN ('7', '11')")
def any_column_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which any column is one of two codes."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return filings.any_column(c, ["7", "11"]).select("c_custkey", "c_nationkey")


IDS = ["A_600519_2023", "", " A_1", "a/b", "C:x", "x?y", "end.", "..", "H_00700"]


@register(rf"""WITH t AS (SELECT o_orderkey, {_pick_sql('o_orderkey', IDS)} AS i, '/data/' || ([ 'raw/x.pdf', '../x.pdf', 'x' ])[CAST(o_orderkey % 3 + 1 AS INTEGER)] AS path FROM orders)
    SELECT o_orderkey, CASE WHEN i = '' THEN 'empty' WHEN i <> trim(i) OR ends_with(i, '.') THEN 'unsafe ends' WHEN contains(i, '/') THEN 'separator' WHEN regexp_matches(i, '^[A-Za-z]:') THEN 'absolute' WHEN regexp_matches(i, '[<>:"|?*]') THEN 'unsafe characters' END AS problem,
        starts_with(path, '/data/raw/') AND NOT contains(path, '..') AS within FROM t""")
def safe_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), _pick("o_orderkey", ["raw/x.pdf", "../x.pdf", "x"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.id_problem(_pick("o_orderkey", IDS)).alias("problem"), rules.is_within(path, F.lit("/data/raw/")).alias("within"))


SUBJECTS = ["募集资金", "主营业务", "其他", "现金流量表", "概览"]


@register(f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') || {_pick_sql('turn', SUBJECTS)} AS t FROM conversations) SELECT conv_id, turn FROM t WHERE {_has(rules.TABLE_WORDS, 't')}")
def table_candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where(rules.has_table_words(F.concat(F.coalesce("text", F.lit("")), _pick("turn", SUBJECTS)))).select("conv_id", "turn")


@register("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def documents_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of some customers as documents of companies, the last first."""
    o = table(spark, sf_dir, "orders").select(F.lit("a").alias("market"), F.col("o_custkey").alias("symbol"), "o_orderkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("A").alias("market"), F.col("c_custkey").alias("symbol"))
    out = filings.documents_of(o, c, [F.desc("o_orderdate"), F.col("o_orderkey")])
    return out.select(F.col("symbol").alias("o_custkey"), "o_orderkey", F.col("place").cast("long").alias("place"))


@register("""WITH l AS (SELECT l_orderkey, count(*) AS indexed FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_orderdate FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND (o_orderkey % 5 = 0 OR o_orderkey % 5 = indexed))
    SELECT c_custkey AS request_id, CAST(o_orderkey AS VARCHAR) AS document_id FROM customer JOIN r ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 OR y = 1995
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY y DESC, o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) = 1""")
def cached_document_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ready order of each customer: its status stands for a matching hash, its lines for indexed pages."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit("A").alias("market"), F.col("o_custkey").alias("symbol"), F.lit("annual_report").alias("document_type"), F.lit("ZH").alias("language"), F.year("o_orderdate").alias("report_year"), F.col("o_orderdate").alias("publish_time"), F.lit("x").alias("sha256"), F.when(F.col("o_orderstatus") != "F", "x").otherwise("y").alias("file_sha256"), (F.col("o_orderkey") % 5).alias("page_count"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("document_id")).agg(F.count("*").alias("indexed"))
    docs = docs.join(lines.select("document_id"), "document_id", "left_semi")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("A").alias("market"), F.col("c_custkey").alias("symbol"), F.lit("annual_report").alias("document_type"), F.lit("ZH").alias("language"), F.when(F.col("c_custkey") % 2 == 1, 1995).alias("year"))
    return filings.cached_document(docs, lines, asked).select("request_id", "document_id")


@register("""WITH s AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 37 % 1000000 AS VARCHAR), 6, '8') AS asked, CASE WHEN s_suppkey % 3 = 0 THEN '920' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') ELSE '600000' END AS found FROM supplier)
    SELECT s_suppkey, CASE WHEN starts_with(found, '920') AND regexp_matches(asked, '^(4|8|920)') THEN found ELSE asked END AS symbol, coalesce(r_name, n_name) AS place, CASE WHEN r_name IS NOT NULL THEN 'region' WHEN n_name IS NOT NULL THEN 'nation' ELSE 'not_found' END AS resolved_by
    FROM s LEFT JOIN region ON r_regionkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_suppkey""")
def canonical_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New codes for old ones, and a cascade of lookups: the first table that has the key."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lpad((k * 37 % 1000000).cast("string"), 6, "8").alias("asked"), F.when(k % 3 == 0, F.concat(F.lit("920"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("600000").alias("found"))
    s = s.select(k.alias("s_suppkey"), rules.canonical_symbol(F.lit("A"), F.col("asked"), F.col("found")).alias("symbol"))
    sources = [("region", table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("s_suppkey"), F.col("r_name").alias("place"))), ("nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("place")))]
    return filings.resolved(s, sources, "s_suppkey", "place").select("s_suppkey", "symbol", "place", "resolved_by")


@register("""SELECT c.c_custkey, coalesce(n.n_name, c.c_name) AS c_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' || c_nationkey ELSE c_name END AS c_name FROM customer) c LEFT JOIN (SELECT 'old' || n_nationkey AS k, n_name FROM nation) n ON n.k = c.c_name""")
def legacy_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("old"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name")).alias("c_name"))
    codes = table(spark, sf_dir, "nation").select(F.concat(F.lit("old"), F.col("n_nationkey").cast("string")).alias("old"), F.col("n_name").alias("new"))
    return filings.mapped(c, codes, "c_name", "old", "new").select("c_custkey", "c_name")


_SIGNATURE = """'hkex|{"market":"' || n_name || '","page":"","symbol":"' || c_custkey || '"}'"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.withColumn("query_signature", rules.signature(F.lit(" HKEX "), {"symbol": F.col("c_custkey").cast("string"), "market": F.concat(F.lit(" "), F.col("n_name")), "page": F.lit(None).cast("string")}))


@register(f"""WITH s AS (SELECT c_custkey, {_SIGNATURE} AS query_signature FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, query_signature, 'HKEX_search_' || left(sha256(query_signature), 32) || '.json' AS cache_key FROM s""")
def query_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("c_custkey", "query_signature", rules.cache_key(F.lit("HKEX"), F.lit("search"), F.col("query_signature")).alias("cache_key"))


@register(f"""WITH s AS (SELECT c_custkey, c_mktsegment, {_SIGNATURE} AS query_signature FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey),
    old AS (SELECT query_signature, 0 AS result_count, TIMESTAMP '2024-01-01 00:00:00' AS expires_at FROM s WHERE c_custkey % 2 = 0),
    new AS (SELECT query_signature, coalesce(len(r), 0) AS result_count, TIMESTAMP '2024-01-02 00:00:00' + to_seconds(greatest(0, c_custkey % 100 - 10)) AS expires_at FROM s LEFT JOIN o ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
    SELECT query_signature, CAST(result_count AS BIGINT) AS result_count, expires_at FROM old WHERE query_signature NOT IN (SELECT query_signature FROM new) UNION ALL SELECT query_signature, CAST(result_count AS BIGINT), expires_at FROM new""")
def query_cache_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written over a cache, those without a result too, each with its time to live."""
    s = _signed(spark, sf_dir)
    first, now = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"))
    none = F.array().cast("array<bigint>")
    cache = s.where("c_custkey % 2 = 0").select("query_signature", first.alias("fetched_at"), first.alias("expires_at"), F.lit(0).cast("long").alias("result_count"), none.alias("records"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("r"))
    answers = s.where("c_mktsegment = 'BUILDING'").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("query_signature", F.coalesce("r", none).alias("records"), "c_custkey")
    ttl = answers.select("query_signature", "records", (F.col("c_custkey") % 100 - 10).cast("int").alias("ttl"))
    return filings.put_queries(cache, ttl, now, F.col("ttl")).select("query_signature", "result_count", "expires_at")


@register("""WITH e AS (SELECT o_custkey AS request_id, o_orderkey % 4 AS rank, count(*) * 3 AS n, CASE WHEN o_orderkey % 4 = 0 THEN 10 ELSE 6 END AS lim FROM orders GROUP BY o_custkey, o_orderkey % 4)
    SELECT request_id, CAST(rank AS BIGINT) AS rank, CAST(least(n, 5) AS BIGINT) AS n_used FROM e WHERE n >= 5 OR n < lim QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank) = 1""")
def query_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present signature and three older ones: the first with enough records, or with all there are."""
    rank = F.col("o_orderkey") % 4
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request_id"), rank.alias("rank")).agg((F.count("*") * 3).alias("n_records")).withColumn("fetch_limit", F.when(F.col("rank") == 0, 10).otherwise(6))
    return filings.usable_entry(e, 5)


@register("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 64 THEN t ELSE left(t, CAST(list_max(list_filter(range(0, 65), lambda i: octet_length(encode(left(t, i))) <= 64)) AS BIGINT)) END AS head FROM t""")
def byte_bounded_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.byte_prefix(F.coalesce("text", F.lit("")), 64).alias("head"))


@register(r"""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y%m%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d.%m.%Y') END AS d, epoch_us(ts) // 1000 AS ms FROM events)
    SELECT event_id, CASE WHEN regexp_matches(d, '^\d{8}$') THEN left(d, 4) || '-' || substring(d, 5, 2) || '-' || substring(d, 7, 2) WHEN regexp_matches(d, '^\d{4}-\d\d-\d\d$') THEN d END AS day, strftime(make_timestamp(ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shanghai FROM t""")
def dates_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    d = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyyMMdd")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "dd.MM.yyyy"))
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1000)
    return table(spark, sf_dir, "events").select("event_id", rules.iso_date(d).alias("day"), rules.shanghai_time(ms).alias("shanghai"))


@register("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN n_name END, ''), c_mktsegment) AS label, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS first_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones unless blank, numbers that are none as null, the first present of several names."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    new = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("n_name"))
    balance = F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    names = F.when(k % 2 == 0, F.col("c_name")).otherwise(" - "), F.when(k % 7 == 0, F.lit("NaN")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", rules.merged(F.col("c_mktsegment"), new).alias("label"), rules.clean_number(balance).alias("balance"), rules.first_present(*names).alias("first_name"))


ITEMS = ["A", "h", "X", " a "]
KINDS = ["", "Prospectus", "annual_report", "interim"]


@register(f"""WITH i AS (SELECT o_orderkey AS row_no, upper(trim({_pick_sql('o_orderkey', ITEMS)})) AS market, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS symbol, coalesce(nullif(lower({_pick_sql('o_custkey', KINDS)}), ''), 'annual_report') AS document_type, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END AS report_year FROM orders)
    SELECT row_no, market, symbol, document_type, CAST(report_year AS BIGINT) AS report_year, CASE WHEN market = 'H' THEN 'EN' ELSE 'ZH' END AS language,
        CASE WHEN market NOT IN ('A', 'H') THEN 'market must be A or H' WHEN symbol = '' THEN 'symbol is required' WHEN document_type NOT IN ('annual_report', 'prospectus') THEN 'document_type must be annual_report or prospectus' END AS problem FROM i""")
def batch_items_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), _pick("o_orderkey", ITEMS).alias("market"), F.when(F.col("o_custkey") % 11 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("symbol"), _pick("o_custkey", KINDS).alias("document_type"), F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate").cast("string")).otherwise("n/a").alias("report_year"), F.lit(None).cast("string").alias("language"))
    return filings.batch_items(o).withColumn("report_year", F.col("report_year").cast("long"))


@register("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') AND bool_or(o_orderstatus = 'F') THEN 'cached' WHEN bool_or(o_orderstatus = 'O') THEN 'accepted' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'needs_review' ELSE 'failed' END AS status FROM orders GROUP BY o_custkey""")
def batch_result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("ok"), F.bool_or(F.col("o_orderstatus") == "F").alias("hit"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return g.select("o_custkey", filings.run_status(F.col("ok"), F.col("hit"), F.array(F.when(F.col("urgent"), "needs_review").otherwise("deleted"))).alias("status"))


@register("""WITH f AS (SELECT 'f' || doc_id AS path, coalesce(length(text), 0) AS length, md5(coalesce(text, '')) AS sha256 FROM documents), d AS (SELECT conv_id, 'f' || conv_id AS path, CASE WHEN conv_id % 4 = 0 THEN 'x' ELSE md5(coalesce(t, '')) END AS sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT doc_id, text AS t FROM documents) ON doc_id = conv_id),
    c AS (SELECT sha256, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1), j AS (SELECT d.*, f.sha256 AS file FROM d LEFT JOIN f USING (path))
    SELECT 'files' AS metric, count(*) AS n FROM f UNION ALL SELECT 'bytes', CAST(sum(length) AS BIGINT) FROM f UNION ALL SELECT 'unreferenced_files', count(*) FROM f WHERE path NOT IN (SELECT path FROM d) AND path NOT IN (SELECT 'f' || doc_id FROM labels)
    UNION ALL SELECT 'redundant_copies', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM c UNION ALL SELECT 'duplicate_groups', count(*) FROM c UNION ALL SELECT 'documents', count(*) FROM d UNION ALL SELECT 'missing_files', count(*) FROM j WHERE file IS NULL UNION ALL SELECT 'hash_mismatches', count(*) FROM j WHERE file <> sha256""")
def cache_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, conversations as the documents that refer to them."""
    docs = table(spark, sf_dir, "documents")
    path = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    files = docs.select(path("doc_id").alias("path"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.md5(F.coalesce("text", F.lit(""))).alias("sha256"))
    known = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(docs.select(F.col("doc_id").alias("conv_id"), "text"), "conv_id", "left")
    known = known.select(F.col("conv_id").cast("string").alias("document_id"), path("conv_id").alias("path"), F.when(F.col("conv_id") % 4 == 0, "x").otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("sha256"))
    return filings.audit(files, known, [table(spark, sf_dir, "labels").select(path("doc_id").alias("path"))])


@register("""WITH g AS (SELECT n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT n_name, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'filings' AS table_name, count(*) AS n_deleted FROM o JOIN g ON g.n_name = o.n_name AND c_custkey = o_custkey UNION ALL SELECT 'source_queries', count(*) FROM g""")
def delete_company_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company goes from its tables and, by the JSON of their signatures, from the cached queries."""
    s = _signed(spark, sf_dir)
    gone = s.where("c_mktsegment = 'MACHINERY'").select(F.col("n_name").alias("market"), F.col("c_custkey").cast("string").alias("symbol"))
    orders = table(spark, sf_dir, "orders").join(s, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("market"), F.col("c_custkey").cast("string").alias("symbol"), "o_orderkey")
    return filings.delete_company({"filings": orders}, s.select("query_signature"), gone)[1]


@register("""WITH l AS (SELECT l_partkey AS url, max({p: 'f' || l_orderkey, d: CAST(l_suppkey AS VARCHAR)}) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
    SELECT p_partkey AS url, coalesce(l.m.p, p_name) AS local_path, coalesce(l.m.d, p_brand) AS document_id FROM part LEFT JOIN l ON l.url = p_partkey""")
def link_files_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("local_path"), F.col("p_brand").alias("document_id"))
    links = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("url"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("local_path"), F.col("l_suppkey").cast("string").alias("document_id"))
    return filings.link_files(parts, links)


@register("""SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS page_no, CASE WHEN role = 'assistant' THEN 'new' ELSE text END AS text FROM conversations""")
def replace_single_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page_no"), "text", "role")
    return filings.replace_page(pages.drop("role"), pages.where("role = 'assistant'").select("document_id", "page_no", F.lit("new").alias("text")))


@register("""WITH t AS (SELECT l_orderkey AS document_id, l_linenumber AS table_index, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 't' || l_linenumber END AS table_path, CASE WHEN l_linenumber % 4 = 1 THEN 'invalid_quality_flags_json' WHEN l_linenumber % 4 = 2 THEN 'ragged_rows|blank_rows' ELSE '' END AS flags, l_returnflag FROM lineitem),
    g AS (SELECT DISTINCT document_id FROM t WHERE l_returnflag = 'R')
    SELECT document_id, CAST(table_index AS BIGINT) AS table_index, 'old' AS table_path, '' AS quality_flags FROM t WHERE document_id NOT IN (SELECT document_id FROM g) UNION ALL SELECT document_id, CAST(table_index AS BIGINT), table_path, flags FROM t WHERE l_returnflag = 'R' AND table_path <> ''""")
def replace_document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables replaced by document; flags read from JSON, broken ones say so."""
    n = F.col("l_linenumber")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), n.cast("long").alias("table_index"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("table_path"), F.when(n % 4 == 1, "{broken").when(n % 4 == 2, '["ragged_rows","blank_rows"]').alias("quality_flags_json"), "l_returnflag")
    old = t.select("document_id", "table_index", F.lit("old").alias("table_path"), F.array().cast("array<string>").alias("quality_flags"))
    return filings.replace_tables(old, t.where("l_returnflag = 'R'")).withColumn("quality_flags", F.array_join("quality_flags", "|"))


@register(r"""SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def jsonp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of callback(...); as rows."""
    body = F.concat(F.lit("callback( "), F.to_json(F.struct("s_name", "s_nationkey")), F.lit(");\n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.from_json(rules.jsonp(body), "s_name string, s_nationkey string").alias("j"))
    return s.select("s_suppkey", F.col("j.s_name").alias("name"), F.col("j.s_nationkey").alias("nation"))


@register("""SELECT coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_name || ' Ltd') AS company_name, c_mktsegment AS status, CAST(c_custkey AS VARCHAR) AS code FROM customer WHERE contains(lower(c_name), '1') AND contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 50""")
def register_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing register with fields under two names, searched by parts of name and status: the first 50."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("企业名称"), F.concat("c_name", F.lit(" Ltd")).alias("issuer"), F.col("c_mktsegment").alias("status"), F.lit(None).cast("string").alias("审核状态"))
    aliases = {"company_name": ["企业名称", "issuer"], "status": ["审核状态", "status"], "code": ["c_custkey"]}
    return filings.register_rows(c, "1", "BUILD", aliases, [F.col("code").cast("long")], 50)


@register(r"""WITH a AS (SELECT page_id, 'r' || page_id AS title, 'https://x.org/listedco/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.htm' END AS url, CASE WHEN page_id % 3 = 0 THEN 'Annual Report' END AS category, page_id || 'KB' AS file_size_label FROM pages)
    SELECT page_id, title, url, category, file_size_label, CASE WHEN ends_with(url, '.pdf') THEN url END AS pdf_url FROM a""")
def title_search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a results table: one row with a filing, one with an address of no filing and one with no title, for each page."""
    k = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 3 == 0, '<div class="headline">Annual\n Report</div>').otherwise("")
    html = F.concat(F.lit("<table><TR><td>"), head, F.lit('<a href="/listedco/'), k, F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".htm"), F.lit('">r<b>'), k, F.lit('</b></a><span class="attachment_filesize">'), k, F.lit('KB</span></td></TR><tr><td><a href="/about">About</a></td></tr><tr><a href="/news/1.pdf"> </a></tr></table>'))
    p = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    out = filings.title_records(p, "https://x.org").withColumn("title", F.regexp_replace("title", " ", ""))
    return out.select("page_id", "title", "url", "category", "file_size_label", "pdf_url")


@register("""SELECT event_type, avg(value) AS mean, median(value) AS median, max(value) AS slowest, count(*) FILTER (value < 100) / count(*) AS pass_rate FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and maximum, and the share that passes a limit."""
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.max("value").alias("slowest"), (F.count_if(F.col("value") < 100) / F.count("*")).alias("pass_rate"))


STATEMENTS = {"balance": "o_totalprice > 100000", "cashflow": "o_orderstatus = 'O'", "income": "o_orderpriority = '1-URGENT'"}


@register(" UNION ALL ".join(f"SELECT '{n}' AS statement, o_orderkey FROM orders WHERE {c}" for n, c in STATEMENTS.items()))
def all_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all asks for three statements, each row with the name of its own."""
    o = table(spark, sf_dir, "orders")
    return readers.statements({n: o.where(c).select("o_orderkey") for n, c in STATEMENTS.items()}, "all")
