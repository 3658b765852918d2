"""Registered queries on names, types, candidates, identity, calculations and reviews, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact, text
from ..operators import documents
from . import review
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


_ROUTE = "CASE " + " ".join(f"WHEN {' AND '.join(_has(g, 'q') for g in groups)} THEN '{name}'" for name, groups in text.ROUTES) + f" ELSE '{text.OTHER_ROUTE}' END"


@register(f"""WITH a AS (SELECT 'b' || item_id AS query_id, lower(text) AS q FROM benchmark UNION ALL SELECT 'd' || doc_id, lower(text) FROM documents UNION ALL SELECT 'l' || doc_id, 'Annual report of ' || quality FROM labels
        UNION ALL SELECT 'p' || p_partkey, lower(p_name || ' revenue list hk') FROM part),
    r AS (SELECT query_id, {_ROUTE} AS route FROM (SELECT query_id, lower(q) AS q FROM a))
    SELECT query_id, route, route IN ('local_document_evidence', 'hybrid_structured_and_filing_evidence', 'unsupported_hk_ipo_annual_list') AS llm_required FROM r""")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("benchmark", F.concat(F.lit("b"), "item_id"), F.col("text")), ("documents", F.concat(F.lit("d"), "doc_id"), F.col("text")), ("labels", F.concat(F.lit("l"), "doc_id"), F.concat(F.lit("Annual report of "), "quality")), ("part", F.concat(F.lit("p"), "p_partkey"), F.concat("p_name", F.lit(" revenue list hk")))]
    every = None
    for name, key, query in parts:
        one = table(spark, sf_dir, name).select(key.alias("query_id"), query.alias("q"))
        every = one if every is None else every.unionByName(one)
    return every.select("query_id", text.route(F.col("q")).alias("route")).withColumn("llm_required", text.needs_model(F.col("route")))


_SLUG = r"trim(regexp_replace(lower(trim({})), '[^0-9a-zA-Z\x{{4e00}}-\x{{9fff}}]+', '_', 'g'), '_')"


@register(rf"""WITH t AS (SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title FROM documents),
    k AS (SELECT *, lower(source || ' ' || title) AS both_ FROM t)
    SELECT doc_id, CASE WHEN contains(both_, 'annual report') THEN 'annual_report' WHEN contains(both_, 'interim') THEN 'interim_report' WHEN contains(both_, 'quarter') THEN 'quarterly_report'
            WHEN contains(both_, 'prospectus') OR contains(both_, 'global offering') THEN 'prospectus' WHEN contains(both_, 'offering') THEN 'offering_document' ELSE left({_SLUG.format("source")}, 40) END AS document_type,
        CASE WHEN upper(lang) IN ('EN', 'ENG') THEN 'EN' WHEN regexp_matches(title, '[\x{{4e00}}-\x{{9fff}}]') THEN 'ZH' ELSE 'EN' END AS language,
        coalesce(nullif(regexp_extract(title, '(?:19|20)\d\d'), ''), 'undated') AS report_year FROM k""")
def document_type_language_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    return docs.select("doc_id", text.document_type(F.col("source"), F.col("title")).alias("document_type"), text.language(F.col("title"), F.col("lang")).alias("language"), text.report_year(F.col("title"), F.lit(None)).alias("report_year"))


@register(rf"""WITH c AS (SELECT c_custkey, n_name AS market, CAST(c_custkey AS VARCHAR) AS symbol, c_name || ' Holdings Ltd.' AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    y AS (SELECT o_custkey, CAST(year(max(o_orderdate)) AS VARCHAR) AS y FROM orders GROUP BY o_custkey),
    s AS (SELECT c.*, coalesce(y, 'undated') AS y, CASE WHEN starts_with(upper(market), 'A') THEN regexp_extract(name, '[A-Za-z0-9\-]+')
            ELSE trim(regexp_replace(regexp_replace(name, '(?i)\b(HOLDINGS?|GROUP|LIMITED|LTD|INC|CORPORATION|CORP|COMPANY|CO)\b\.?', '', 'g'), '\s+', '_', 'g'), '_ .') END AS short FROM c LEFT JOIN y ON o_custkey = c_custkey)
    SELECT c_custkey, left(upper(left({_SLUG.format("market")}, 8)) || '_' || upper(left({_SLUG.format("symbol")}, 16)) || '_' || y || '_annual_report_EN_' || left(regexp_replace(trim(regexp_replace(short, '\s+', '_', 'g'), ' ._'), '_+', '_', 'g'), 40), 140) AS document_id FROM s""")
def document_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.year(F.max("o_orderdate")).cast("string").alias("y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(years, F.col("o_custkey") == F.col("c_custkey"), "left")
    name = F.concat("c_name", F.lit(" Holdings Ltd."))
    return c.select("c_custkey", text.document_id(F.col("n_name"), F.col("c_custkey"), text.report_year(F.lit(None), F.lit(None), F.col("y")), F.lit("annual_report"), F.lit("EN"), text.company_short_name(F.col("n_name"), name)).alias("document_id"))


@register(rf"""SELECT p_partkey, left(regexp_replace(regexp_replace(trim(regexp_replace(p_name, '[\\/:*?"<>|\r\n\t]+', '_', 'g'), ' ._'), '\s+', '_', 'g'), '_+', '_', 'g'), 120) AS name, left({_SLUG.format("p_name || '/' || p_brand")}, 80) AS slug FROM part""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(F.col("p_name")).alias("name"), text.safe_slug(F.concat_ws("/", "p_name", "p_brand")).alias("slug"))


@register("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey < 50 THEN 'SH' ELSE 'hk.' END || s_suppkey || CASE WHEN s_suppkey < 50 THEN '.sh' ELSE '' END AS raw FROM supplier)
    SELECT s_suppkey, replace(replace(replace(replace(upper(raw), 'SH', ''), 'SZ', ''), 'BJ', ''), '.', '') AS a_symbol,
        lpad(replace(replace(upper(raw), 'HK', ''), '.', ''), CAST(greatest(5, length(replace(replace(upper(raw), 'HK', ''), '.', ''))) AS INT), '0') AS h_symbol,
        CASE WHEN regexp_matches(replace(replace(replace(replace(upper(raw), 'SH', ''), 'SZ', ''), 'BJ', ''), '.', ''), '^[69]') THEN 'SH' WHEN regexp_matches(replace(replace(replace(replace(upper(raw), 'SH', ''), 'SZ', ''), 'BJ', ''), '.', ''), '^[48]') THEN 'BJ' ELSE 'SZ' END AS exchange FROM s""")
def symbol_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("s_suppkey") < 50
    raw = F.concat(F.when(low, "SH").otherwise("hk."), F.col("s_suppkey").cast("string"), F.when(low, ".sh").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.a_symbol(raw).alias("a_symbol"), text.h_symbol(raw).alias("h_symbol"), text.a_exchange(raw).alias("exchange"))


@register(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS body,
    regexp_extract(url, '/([^/]+)$', 1) AS leaf, coalesce(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host FROM pages""")
def html_clean_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"), F.regexp_extract("url", "/([^/]+)$", 1).alias("leaf"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


@register(r"""WITH t AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages),
    s AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS low FROM t),
    p AS (SELECT *, CASE WHEN contains(low, 'annual report') THEN 10 ELSE 0 END + 3 + CASE WHEN regexp_matches(low, '^(?:annual report(?: and accounts)? \d{4}|(?:fiscal year )?\d{4} annual report(?: and accounts)?)(?:\s*\([^)]*\))?$') THEN 35 ELSE 0 END
            + CASE WHEN contains(low, 'with employee share plans') THEN 5 ELSE 0 END
            - CASE WHEN contains(low, 'summary') OR contains(low, 'notification') OR contains(low, 'notice of publication') OR contains(low, 'reply form') OR contains(low, 'letter to') OR contains(low, 'form of proxy') OR contains(low, 'proxy form')
                OR contains(low, 'overseas regulatory announcement') OR contains(low, 'h-share announcement') OR contains(low, 'esg') THEN 45 ELSE 0 END AS score,
            coalesce(TRY_CAST(nullif(regexp_extract(title, '(?:19|20)\d\d'), '') AS INT), 0) AS y FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, y DESC, page_id) AS rank, lead(score) OVER w AS s2, lead(low) OVER w AS l2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY host ORDER BY score DESC, y DESC, page_id))
    SELECT host, page_id, title, CAST(score AS BIGINT) AS score, NOT (s2 IS NULL OR score > s2 OR (score >= 60 AND low = l2) OR y > y2) AS ambiguous FROM r WHERE rank = 1""")
def candidate_rank_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best page of each host as an annual report, or that it is ambiguous."""
    c = table(spark, sf_dir, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.lit("").alias("document_type"), F.lit("").alias("pdf_url"), F.lit("").alias("publish_time"))
    scored = c.withColumn("score", documents.candidate_score("annual_report", None, "EN").cast("long"))
    chosen = documents.select_candidate(documents.rank_candidates(scored, ["host"], None, ["page_id"]), ["host"], True, None)
    return chosen.select("host", "page_id", "title", "score", "ambiguous")


@register(r"""WITH e AS (SELECT doc_id, coalesce(text, '') AS t, 2012 + doc_id % 10 AS y, split_part(coalesce(text, ''), ' ', 3) || ' Group Ltd' AS company, lpad(CAST(doc_id % 1000 AS VARCHAR), 5, '0') || '.HK' AS symbol FROM documents),
    m AS (SELECT *, contains(t, CAST(y AS VARCHAR)) AS year_match,
        list_filter(regexp_extract_all(lower(company), '[0-9a-z]+|[\x{4e00}-\x{9fff}]+'), lambda x: length(x) >= 3 AND x NOT IN ('company', 'corporation', 'group', 'holdings', 'holding', 'limited', 'ltd', 'inc', 'plc')) AS tokens,
        regexp_replace(lower(t), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS body, left(symbol, 5) AS code FROM e),
    r AS (SELECT *, CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: contains(body, x))) > 0 END AS company_match,
        regexp_matches(t, '(^|[^0-9])' || code || '([^0-9]|$)') OR regexp_matches(t, '(?i)stock\s*code[^0-9]{0,24}0*' || coalesce(nullif(ltrim(code, '0'), ''), code) || '([^0-9]|$)') AS symbol_match FROM m)
    SELECT doc_id, year_match, company_match, symbol_match, year_match AND (coalesce(company_match, false) OR symbol_match) AS passed FROM r""")
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (2012 + F.col("doc_id") % 10).alias("expected_year"), F.concat(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(3)), F.lit(" Group Ltd")).alias("expected_company"), F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), 5, "0"), F.lit(".HK")).alias("expected_symbol"))
    return documents.identity(docs).select("doc_id", "year_match", "company_match", "symbol_match", "passed")


@register()
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each text; SQL engines without look-behind cannot say it, so it is tested against a plain version."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(exact.number_tokens(F.col("text"))).alias("pos", "n")).select("doc_id", "pos", "n.value", "n.percent")


_LINE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))"


@register(f"""WITH l AS (SELECT l_orderkey, CAST(sum({_LINE}) AS DECIMAL(28,6)) AS calculated FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, CAST(calculated AS VARCHAR) AS calculated, CAST(CAST(abs(calculated - CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,6)) AS VARCHAR) AS difference,
        CASE WHEN abs(calculated - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.005 OR (o_totalprice <> 0 AND abs(calculated - CAST(o_totalprice AS DECIMAL(18,2))) <= CAST(0.5 AS DECIMAL(4,2)) * abs(CAST(o_totalprice AS DECIMAL(18,2)))) THEN 'verified' ELSE 'discrepancy' END AS status
    FROM orders JOIN l ON l_orderkey = o_orderkey""")
def calc_tieout_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sums against order totals, within half a cent or half of the total."""
    price, discount, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(price * (1 - discount) * (1 + tax)).cast("decimal(28,6)").alias("calculated"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("expected")).join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    difference = F.abs(F.col("calculated") - F.col("expected"))
    close = exact.within(difference, F.col("expected"), F.lit("0.005").cast("decimal(6,3)"), F.lit("0.5").cast("decimal(4,2)"))
    return both.select("o_orderkey", F.col("calculated").cast("string").alias("calculated"), difference.cast("decimal(28,6)").cast("string").alias("difference"), F.when(close, "verified").otherwise("discrepancy").alias("status"))


@register("""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(o_custkey AS DECIMAL(18,2)) AS b FROM orders)
    SELECT o_orderkey, CAST(CAST(abs(a - b) * 2 + greatest(a, b) * 3 - CAST(0.25 AS DECIMAL(4,2)) AS DECIMAL(28,4)) AS VARCHAR) AS value FROM o""")
def calc_expression_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated expression over the values of each order, to the last digit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("a"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("b"), F.col("o_custkey").cast("string")).alias("names"))
    done = o.withColumn("r", exact.evaluated(F.lit("abs(a - b) * 2 + max(a, b) * 3 - 0.25"), F.col("names")))
    return done.select("o_orderkey", F.col("r.value").cast("decimal(28,4)").cast("string").alias("value"))


def _line_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set for each order, with one calculation that adds up the quantities of its lines; flags are units, states are periods."""
    none = F.lit(None).cast("string")
    q = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    v = F.struct(F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("name"), q.alias("value"), F.lit("1").alias("scale"), F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("period"), none.alias("scope"), none.alias("currency"), none.alias("evidence_id"), F.lit("assumption").alias("source_type"), none.alias("calculation_id"), F.lit("number").alias("source_format"), F.lit("equal").alias("relation"))
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.sort_array(F.collect_list(v)).alias("variables"))
    extra = [none.alias("expected"), none.alias("absolute_tolerance"), none.alias("relative_tolerance"), F.lit(None).cast("int").alias("expected_precision")]
    return sets.select("set_id", F.lit("sum").alias("calculation_id"), F.array_join(F.transform("variables", lambda x: x["name"]), " + ").alias("expression"), *extra, "variables")


def _no_evidence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "evidence_id string, text string")


@register("""WITH d AS (SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS again, count(DISTINCT l_returnflag) AS u, count(DISTINCT l_linestatus) AS p, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN again > 0 THEN NULL ELSE CAST(q AS VARCHAR) END AS total, CASE WHEN again > 0 THEN 'invalid' WHEN u > 1 OR p > 1 THEN 'context_mismatch' ELSE 'calculated' END AS status FROM d""")
def calc_context_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over lines of different units or periods do not hold; lines of one number are a repeated name."""
    from . import calculations

    sets = _line_sets(spark, sf_dir).withColumn("checks", F.array(F.lit("same_unit"), F.lit("same_period")))
    done = calculations.verify(sets, _no_evidence(spark))
    return done.select(F.col("set_id").alias("l_orderkey"), F.col("calculated").cast("decimal(18,2)").cast("string").alias("total"), "status")


@register("""WITH d AS (SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS again FROM lineitem GROUP BY l_orderkey), n AS (SELECT l_orderkey AS set_id, l_orderkey % 4 AS k, again FROM d)
    SELECT set_id, CAST(CASE k WHEN 1 THEN 31 ELSE 2 END AS BIGINT) AS n, 'invalid' AS status FROM n WHERE k < 3 UNION ALL SELECT set_id, 2, CASE WHEN again > 0 THEN 'invalid' ELSE 'context_mismatch' END FROM n WHERE k = 3""")
def calc_set_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with a repeated id, with too many calculations, with a precision out of bounds, and good ones that lack required data: none hinders another."""
    from . import calculations

    k, name = F.col("set_id") % 4, F.col("number").cast("string")
    sets = _line_sets(spark, sf_dir).withColumns({"checks": F.array().cast("array<string>"), "required_metadata": F.array(F.lit("scope")), "number": F.explode(F.sequence(F.lit(1), F.when(k == 1, 31).otherwise(2)))})
    sets = sets.withColumns({"calculation_id": F.when(k == 0, "same").otherwise(name), "expected_precision": F.when(k == 2, 13)}).drop("number")
    return calculations.set_status(calculations.verify(sets, _no_evidence(spark))).select("set_id", "n", "status")


@register("""SELECT CAST(l_partkey AS VARCHAR) AS claim_id, lower(l_returnflag) AS fact_key, lower(l_linestatus) AS period, count(DISTINCT l_quantity) AS n_values, count(DISTINCT l_orderkey) AS n_evidence, min(l_quantity) AS least, max(l_quantity) AS most
    FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_orderkey) > 1""")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_returnflag").alias("fact_key"), F.col("l_linestatus").alias("period"), F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("evidence_id"))
    return review.conflicts(facts, ["claim_id", "fact_key", "period"])


_STATUS = "CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'calculated' WHEN 'purchase' THEN 'discrepancy' ELSE 'verified' END"


@register(f"""WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_STATUS} AS status FROM events), r AS (SELECT *, CASE status WHEN 'invalid' THEN 1 WHEN 'unlinked' THEN 2 WHEN 'context_mismatch' THEN 3 WHEN 'discrepancy' THEN 4 WHEN 'calculated' THEN 5 ELSE 6 END AS k FROM s)
    SELECT user_id, day, count(*) AS n, CASE min(k) WHEN 4 THEN 'discrepancy' WHEN 5 THEN 'calculated' ELSE 'verified' END AS status FROM r GROUP BY user_id, day""")
def status_rollup_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.expr(_STATUS).alias("status"))
    return review.roll_up(e, ["user_id", "day"])


_BOUND = "CASE event_type WHEN 'view' THEN 'matched' WHEN 'click' THEN 'not_applicable' WHEN 'purchase' THEN 'not_found' ELSE 'not_checked' END"


@register(f"""WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_BOUND} AS s FROM events)
    SELECT user_id, day, CASE WHEN bool_or(s = 'not_found') THEN 'failed' WHEN count(*) FILTER (s <> 'not_applicable') > 0 AND count(*) FILTER (s NOT IN ('not_applicable', 'matched')) = 0 THEN 'verified'
        WHEN bool_or(s <> 'not_applicable') THEN 'not_checked' ELSE 'not_applicable' END AS source_binding_status FROM s GROUP BY user_id, day""")
def source_binding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.expr(_BOUND).alias("source_status"))
    return review.binding_status(e, ["user_id", "day"])


@register("SELECT conv_id || '/' || turn // 30 AS plan_id, CAST(turn AS VARCHAR) AS claim_id, CAST(turn % 30 AS BIGINT) AS layer FROM conversations")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of 30 turns at most, the bound of a plan; each turn depends on the one before and, from the third on, on the first of its plan."""
    c = table(spark, sf_dir, "conversations").withColumns({"part": F.floor(F.col("turn") / 30), "at": F.col("turn") % 30})
    deps = F.filter(F.array(F.when(F.col("at") > 0, (F.col("turn") - 1).cast("string")), F.when(F.col("at") > 2, (F.col("turn") - F.col("at")).cast("string"))), lambda x: x.isNotNull())
    claims = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("part").cast("string")).alias("plan_id"), F.col("turn").cast("string").alias("claim_id"), deps.alias("depends_on"))
    return review.layers(claims).withColumn("layer", F.col("layer").cast("long"))


@register("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS need, turn // 30 AS part, row_number() OVER (PARTITION BY conv_id, turn // 30 ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, turn // 30) AS n FROM conversations),
    w AS (SELECT conv_id, part, turn, i, least(500, 2000 // n, need) AS granted, 2000 - least(500, 2000 // n, need) AS rest FROM c WHERE i = 1
        UNION ALL SELECT c.conv_id, c.part, c.turn, c.i, least(500, w.rest // (c.n - c.i + 1), c.need), w.rest - least(500, w.rest // (c.n - c.i + 1), c.need) FROM w JOIN c ON c.conv_id = w.conv_id AND c.part = w.part AND c.i = w.i + 1)
    SELECT conv_id, turn, CAST(granted AS BIGINT) AS granted FROM w""")
def fair_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 30).alias("part"), "turn", F.length("text").alias("need"))
    return review.fair_share(claims, 2000, 500, ["conv_id", "part"], ["turn"], "need").select("conv_id", "turn", "granted")


@register("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant'),
    j AS (SELECT c.conv_id, c.turn, p.k, max(p.k) OVER (PARTITION BY c.conv_id) AS used, sum(CASE WHEN p.k IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fresh FROM conversations c LEFT JOIN p USING (conv_id, turn))
    SELECT conv_id, turn, conv_id || ':e' || coalesce(k, CAST(coalesce(used, 0) + fresh AS BIGINT)) AS evidence_id FROM j""")
def evidence_ids_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns have ids from before, the last first; the other turns get the next numbers."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    prior = c.where("role = 'assistant'").withColumn("k", k).select("conv_id", "turn", F.concat_ws(":e", F.col("conv_id").cast("string"), F.col("k").cast("string")).alias("evidence_id"))
    return review.evidence_ids(c.drop("role"), prior, ["conv_id"], ["turn"], ["turn"]).select("conv_id", "turn", "evidence_id")


@register("""SELECT l_orderkey, CAST(1 AS INTEGER) AS header_depth, CAST(0.75 AS DOUBLE) AS confidence, CAST(count(*) + 1 AS INTEGER) AS row_count, CAST(3 AS INTEGER) AS column_count, '项目|数量合计|金额' AS column_paths FROM lineitem GROUP BY l_orderkey""")
def table_header_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as a table with a header row, and the structure found in it: two of three cells of a line are numbers and all of the header are words, so its score is 0.55 * 2/3 + 0.2 + 0.15 + 0.05 * 2/3."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.array(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("c")))).alias("rows"))
    header = F.array(F.array(F.lit("项目"), F.lit("数量合计"), F.lit("金额")))
    return cells.select("l_orderkey", documents.structure_of(F.concat(header, F.col("rows.c"))).alias("s")).select("l_orderkey", "s.header_depth", "s.confidence", "s.row_count", "s.column_count", F.array_join(F.transform("s.column_paths", lambda p: F.array_join(p, ">")), "|").alias("column_paths"))


@register("""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
    SELECT o_orderkey AS set_id, 'gross' AS calculation_id, CAST(CAST(p + 10 AS DECIMAL(18,2)) AS VARCHAR) AS calculated, CASE o_orderstatus WHEN 'F' THEN 'unlinked' ELSE 'calculated' END AS status, true AS assumption_based FROM o
    UNION ALL SELECT o_orderkey, 'net', CASE o_orderstatus WHEN 'F' THEN NULL ELSE CAST(CAST((p + 10) * 2 - p AS DECIMAL(18,2)) AS VARCHAR) END, CASE o_orderstatus WHEN 'F' THEN 'invalid' WHEN 'O' THEN 'verified' ELSE 'discrepancy' END, false FROM o""")
def calc_graph_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calculations for each order, the second on the result of the first; closed orders cite a text without their total."""
    from . import calculations

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    key, p, status = F.col("o_orderkey"), F.col("p").cast("string"), F.col("o_orderstatus")
    cite = F.concat(F.lit("e"), key.cast("string"))
    evidence = o.select(cite.alias("evidence_id"), F.when(status == "F", "The total is not stated.").otherwise(F.concat(F.lit("Total: "), F.format_number("p", 2), F.lit("."))).alias("text"))
    var = lambda name, value, kind, eid, dep: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("1").alias("scale"), *[F.lit(None).cast("string").alias(f) for f in calculations.FIELDS], eid.alias("evidence_id"), F.lit(kind).alias("source_type"), F.lit(dep).cast("string").alias("calculation_id"), F.lit("number").alias("source_format"), F.lit("equal").alias("relation"))
    none = F.lit(None).cast("string")
    extra = [none.alias("absolute_tolerance"), none.alias("relative_tolerance"), F.lit(None).cast("int").alias("expected_precision"), F.array().cast("array<string>").alias("checks")]
    gross = o.select(key.alias("set_id"), F.lit("gross").alias("calculation_id"), F.lit("p + more").alias("expression"), none.alias("expected"), *extra, F.array(var("p", p, "evidence", cite, None), var("more", F.lit("10"), "assumption", none, None)).alias("variables"))
    want = F.when(status == "O", (F.col("p") + 20).cast("string")).otherwise((F.col("p") + 21).cast("string"))
    net = o.select(key.alias("set_id"), F.lit("net").alias("calculation_id"), F.lit("g * 2 - p").alias("expression"), want.alias("expected"), *extra, F.array(var("g", none, "calculation", none, "gross"), var("p", p, "evidence", cite, None)).alias("variables"))
    done = calculations.verify(gross.unionByName(net), evidence)
    return done.select("set_id", "calculation_id", F.when(F.col("calculated").isNotNull(), F.col("calculated").cast("decimal(18,2)").cast("string")).alias("calculated"), "status", "assumption_based")
