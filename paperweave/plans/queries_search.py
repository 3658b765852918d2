"""Registered queries on search and evidence, each with its SQL. Conversations stand for paged documents, and so do the lines of documents."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..operators import documents, evidence, index, search
from ..session import shared_dir
from ..sources import readers, writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).alias("page_no"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return each.select("document_id", (F.col("pos") + 1).cast("long").alias("page_no"), "text")


def kept_turns(spark: SparkSession, sf_dir: str) -> index.PageIndex:
    """The index of all turns: made once for the table, and used by every later query; its trigrams are made before the first that searches substrings."""
    return _kept(spark, sf_dir, "conversations", turns(spark, sf_dir), trigrams=False)


def kept_lines(spark: SparkSession, sf_dir: str) -> index.PageIndex:
    return _kept(spark, sf_dir, "documents", lines(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str, name: str, pages: DataFrame, trigrams: bool = True) -> index.PageIndex:
    source = table(spark, sf_dir, name)
    return index.kept(spark, f"{name}-{zlib.crc32(sf_dir.encode()):08x}", source, pages, shared_dir(spark), trigrams)


TURNS = "pages AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS page_no, text FROM conversations)"
LINES = """pages AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS page_no,
    unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"""
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"


def word_sql(queries: str, body: str = "document_id || ' ' || text") -> str:
    """CTEs from pages and queries(query_id, query) to hits."""
    return f"""{queries},
        wanted AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS token FROM (SELECT query_id, {TOKENS.format("query")} AS t FROM queries)),
        posted AS (SELECT document_id, page_no, unnest({TOKENS.format(body)}) AS token FROM pages),
        hits AS (SELECT query_id, document_id, page_no FROM posted JOIN wanted USING (token) GROUP BY query_id, document_id, page_no, n_terms HAVING count(*) = n_terms)"""


BENCHMARK = r"queries AS (SELECT item_id AS query_id, regexp_extract(text, '^\s*\S+\s+\S+') AS query FROM benchmark)"


@register(f"WITH {LINES}, {word_sql(BENCHMARK)} SELECT query_id, document_id, page_no FROM hits")
def search_word_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that have the first two words of a benchmark item."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"^\s*\S+\s+\S+", 0).alias("query"))
    return index.word_hits(kept_lines(spark, sf_dir), queries)


SUBSTRINGS = [("s1", "the thing"), ("s2", "Apache License"), ("s3", "de la"), ("s4", "no such words"), ("s5", "disgusting")]


def substring_sql(queries: list[tuple[str, str]], relaxed: bool = False) -> str:
    values = ", ".join("('{}', '{}', [{}], [{}])".format(n, q.lower(), ", ".join(f"'{''.join(t.lower().split())}'" for t in search.terms_of(q)), ", ".join(f"'{t.lower()}'" for t in search.terms_of(q)[1:17] if len(t) >= 2)) for n, q in queries)
    score = r"""list_sum(list_transform(terms, lambda t: CASE WHEN contains(body, t) THEN 100 + least(20, (length(body) - length(replace(body, t, ''))) // length(t)) ELSE 0 END))"""
    return f"""asked(query_id, query, terms, parts) AS (VALUES {values}),
        found AS (SELECT query_id, document_id, page_no, contains(low, query) AS whole, CAST({score} AS BIGINT) AS score
            FROM (SELECT *, lower(text) AS low, regexp_replace(lower(text), '\\s+', '', 'g') AS body FROM pages), asked
            WHERE contains(low, query) OR len(list_filter(parts, lambda t: contains(low, t))) > 0),
        subs AS (SELECT query_id, document_id, page_no, score FROM found WHERE {"true" if relaxed else "whole OR query_id NOT IN (SELECT query_id FROM found WHERE whole)"})"""


@register(f"WITH {LINES}, {substring_sql(SUBSTRINGS)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_no, document_id) AS rank FROM subs QUALIFY rank <= 50")
def search_substring_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best lines of each query."""
    hits = index.substring_hits(kept_lines(spark, sf_dir), SUBSTRINGS).withColumn("score", F.col("score").cast("long"))
    return search.top(hits, 50, [F.desc("score"), F.col("page_no"), F.col("document_id")]).withColumn("rank", F.col("rank").cast("long"))


LONG = [("h1", "the thing of tion"), ("h2", "un de la que les")]
_LONG_VALUES = ", ".join(f"('{n}', '{q}')" for n, q in LONG)


@register(f"""WITH {TURNS}, {word_sql(f"queries(query_id, query) AS (VALUES {_LONG_VALUES})")}, {substring_sql(LONG, True)},
    both_ AS (SELECT query_id, document_id, page_no, 0 AS branch, NULL AS score FROM hits UNION ALL SELECT query_id, document_id, page_no, 1, score FROM subs)
    SELECT query_id, document_id, page_no, CAST(min(branch) AS BIGINT) AS branch, CAST(max(score) AS BIGINT) AS score FROM both_ GROUP BY query_id, document_id, page_no""")
def search_hybrid_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with all words of a longer query first, then those with some of them."""
    asked = spark.createDataFrame(LONG, "query_id string, query string")
    hits = search.hybrid_hits(turns(spark, sf_dir), LONG, asked, kept_turns(spark, sf_dir))
    return hits.select("query_id", "document_id", "page_no", F.col("branch").cast("long").alias("branch"), F.col("score").cast("long").alias("score"))


PHRASES = [("p1", "the thing of"), ("p2", "in the of"), ("p3", "and the to"), ("p4", "de la")]
_PHRASE_VALUES = ", ".join(f"('{n}', '{q}')" for n, q in PHRASES)


@register(rf"""WITH {TURNS}, {word_sql(f"queries(query_id, query) AS (VALUES {_PHRASE_VALUES})")},
    marked AS (SELECT h.*, q.query_id <> 'p4' AS strict, contains(regexp_replace(lower(p.text), '\s+', ' ', 'g'), q.query) AS has
        FROM hits h JOIN queries q USING (query_id) JOIN pages p USING (document_id, page_no))
    SELECT query_id, document_id, page_no FROM marked WHERE NOT strict OR has OR query_id NOT IN (SELECT query_id FROM marked WHERE has)""")
def search_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word hits, held to the exact phrase where a small word is in the query and some page has the phrase."""
    asked = spark.createDataFrame(PHRASES, "query_id string, query string")
    pages = turns(spark, sf_dir)
    return search.phrase_filter(index.word_hits(kept_turns(spark, sf_dir), asked), pages, asked)


@register("""WITH p AS (SELECT doc_id, coalesce(text, '') AS body, list_filter([strpos(lower(coalesce(text, '')), 'license'), strpos(lower(coalesce(text, '')), 'worthless')], lambda x: x > 0) AS places FROM documents)
    SELECT doc_id, CASE WHEN length(body) <= 800 THEN body ELSE substring(body, greatest(1, coalesce(list_min(places), 1) - 160), 800) END AS snippet FROM p""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), ["license", "worthless"]).alias("snippet"))


@register("""WITH p AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(nullif(strpos(lower(coalesce(text, '')), 'apache license'), 0), nullif(strpos(lower(coalesce(text, '')), 'license'), 0),
        nullif(strpos(lower(coalesce(text, '')), 'apache'), 0), nullif(strpos(lower(coalesce(text, '')), 'scum'), 0), 0) AS hit FROM documents),
    e AS (SELECT *, least(length(body), greatest(0, hit - 1 - 66) + 200) AS fin FROM p)
    SELECT doc_id, CASE WHEN length(body) <= 200 THEN body WHEN hit = 0 THEN left(body, 200) ELSE
        CASE WHEN fin > 200 THEN '...' ELSE '' END || substring(body, greatest(0, fin - 200) + 1, 200) || CASE WHEN fin < length(body) THEN '...' ELSE '' END END AS excerpt FROM e""")
def excerpt_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", search.excerpt(F.col("text"), ["Apache License", "scum"], 200).alias("excerpt"))


#: Stated queries with the evidence type that each looks for.
MULTI = [("the thing", "user_query"), ("tion", "mda"), ("und", "kpi_driver"), ("de la", "policy_section"), ("el que", "critical_estimate"), ("of", "incentive")]
_MULTI_VALUES = ", ".join(f"('{q}', '{q}', '{t}')" for q, t in MULTI)
MERGED = f"""{TURNS}, {word_sql(f"queries(query_id, query, evidence_type) AS (VALUES {_MULTI_VALUES})", "document_id || ' ' || text")},
    merged AS (SELECT document_id, page_no, list_sort(list_distinct(list(query_id))) AS matched_queries, list_sort(list_distinct(list(evidence_type))) AS evidence_types, false AS is_adjacent
        FROM hits JOIN queries USING (query_id) GROUP BY document_id, page_no)"""
ADJACENT = f"""{MERGED},
    near AS (SELECT document_id, page_no + unnest([-1, 1]) AS page_no, matched_queries FROM merged),
    hits2 AS (SELECT * FROM merged UNION ALL
        SELECT n.document_id, n.page_no, list_sort(list_distinct(flatten(list(n.matched_queries)))), ['adjacent'], true FROM near n
        SEMI JOIN pages p ON p.document_id = n.document_id AND p.page_no = n.page_no ANTI JOIN merged m ON m.document_id = n.document_id AND m.page_no = n.page_no
        GROUP BY n.document_id, n.page_no)"""
_PRIORITY = "CASE t " + " ".join(f"WHEN '{k}' THEN {p}" for k, (p, _) in evidence.TYPES.items()) + " ELSE 0 END"
_ORDER = "CASE t " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(evidence.TYPES)) + " END"
_QUOTA = "CASE t " + " ".join(f"WHEN '{k}' THEN {q}" for k, (_, q) in evidence.TYPES.items()) + " ELSE 0 END"
DIVERSE = f"""{ADJACENT},
    ranked AS (SELECT *, list_max(list_transform(evidence_types, lambda t: {_PRIORITY})) AS pri, CASE WHEN is_adjacent THEN 0 ELSE 1 END AS direct, len(matched_queries) AS n FROM hits2),
    overall AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pri DESC, direct DESC, n DESC, page_no) AS o FROM ranked),
    typed AS (SELECT *, unnest(evidence_types) AS t FROM overall),
    placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, t ORDER BY direct DESC, n DESC, pri DESC, o) AS r FROM typed),
    slots AS (SELECT document_id, page_no, min(CASE WHEN r <= {_QUOTA} THEN {_ORDER} * 100000 + r ELSE {len(evidence.TYPES)} * 100000 + o END) AS slot FROM placed GROUP BY document_id, page_no),
    chosen AS (SELECT document_id, page_no, row_number() OVER (PARTITION BY document_id ORDER BY slot, page_no) AS place FROM slots QUALIFY place <= 3)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = turns(spark, sf_dir)
    asked = spark.createDataFrame([(q, q, t) for q, t in MULTI], "query_id string, query string, evidence_type string")
    hits = index.word_hits(kept_turns(spark, sf_dir), asked).join(asked, "query_id").withColumn("snippet", F.lit(None).cast("string"))
    return evidence.merge(hits), pages


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    merged, pages = _merged(spark, sf_dir)
    return evidence.select_diverse(evidence.with_adjacent(merged, pages), 3, ["document_id"], ["page_no"]), pages


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen pages with their texts, without adjacent pages of little use."""
    chosen, pages = _selected(spark, sf_dir)
    wide = chosen.join(pages, ["document_id", "page_no"]).where(~F.col("is_adjacent") | evidence.useful_adjacent(F.col("text"), F.col("page_no")))
    return wide.select("document_id", "page_no", F.col("place").cast("long").alias("place"), "matched_queries", "text")


def joined(name: str) -> F.Column:
    return F.array_join(name, "|").alias(name)


@register(f"WITH {MERGED} SELECT document_id, page_no, array_to_string(matched_queries, '|') AS matched_queries, array_to_string(evidence_types, '|') AS evidence_types FROM merged")
def hit_merge_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("document_id", "page_no", joined("matched_queries"), joined("evidence_types"))


@register(f"WITH {ADJACENT} SELECT document_id, page_no, array_to_string(matched_queries, '|') AS matched_queries, is_adjacent FROM hits2")
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_adjacent(*_merged(spark, sf_dir)).select("document_id", "page_no", joined("matched_queries"), "is_adjacent")


@register(f"WITH {DIVERSE} SELECT document_id, page_no, CAST(place AS BIGINT) AS place FROM chosen")
def diverse_topk_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pages of each document that its types' quotas choose."""
    return _selected(spark, sf_dir)[0].select("document_id", "page_no", F.col("place").cast("long").alias("place"))


@register(rf"""WITH {DIVERSE},
    texts AS (SELECT c.*, substring(p.text, 1, 500) AS text FROM chosen c JOIN pages p USING (document_id, page_no) JOIN hits2 h USING (document_id, page_no)
        WHERE NOT h.is_adjacent OR (page_no > 1 AND length(trim(regexp_replace(p.text, '\s+', ' ', 'g'))) >= 200)),
    sums AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM texts)
    SELECT document_id, page_no, CAST(place AS BIGINT) AS place, length(text) > 1200 - before AS truncated, substring(text, 1, CAST(1200 - before AS BIGINT)) AS text FROM sums WHERE before < 1200""")
def evidence_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, merge, adjacent pages, quotas, texts and budget: one packet for each document. As its SQL says, texts are cut to their first characters; excerpt_packet cuts them around the matches."""
    short = _texts(spark, sf_dir).select("document_id", "page_no", "place", F.substring("text", 1, 500).alias("text"))
    return evidence.budget(short, 1200, ["document_id"], ["place"])


def excerpt_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with an excerpt of each page around the queries that chose it."""
    return evidence.excerpt_budget(_texts(spark, sf_dir), 1200, 500, ["document_id"], ["place"]).select("document_id", "page_no", "place", "text", "truncated")


@register(f"""WITH {TURNS}, sums AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages)
    SELECT document_id, page_no, length(text) > 1500 - before AS truncated, substring(text, 1, CAST(1500 - before AS BIGINT)) AS text FROM sums WHERE before < 1500""")
def char_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.budget(turns(spark, sf_dir), 1500, ["document_id"], ["page_no"])


@register(f"""WITH {TURNS}, cut AS (SELECT document_id, page_no, substring(text, 1, 375) AS text FROM pages),
    sums AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cut)
    SELECT document_id, page_no, length(text) > 1500 - before AS truncated, substring(text, 1, CAST(1500 - before AS BIGINT)) AS text FROM sums WHERE before < 1500""")
def page_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.page_budget(turns(spark, sf_dir), 1500, 4, ["document_id"], ["page_no"])


@register(f"""WITH {TURNS}, turned AS (SELECT *, length(text) AS n, CAST(document_id AS BIGINT) // 20 AS packet FROM pages),
    t AS (SELECT packet, document_id, page_no, row_number() OVER (PARTITION BY packet, document_id ORDER BY n, page_no) AS turn FROM turned)
    SELECT packet, document_id, page_no, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (PARTITION BY packet ORDER BY turn, document_id) AS BIGINT) AS place FROM t""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the 20 documents of a packet one by one in turn, the shortest first; packets grow in number with the data, not in size."""
    items = turns(spark, sf_dir).select(F.floor(F.col("document_id").cast("long") / 20).alias("packet"), "document_id", "page_no", F.length("text").alias("n"))
    out = evidence.interleave(items, ["packet"], ["n", "page_no"])
    return out.select("packet", "document_id", "page_no", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@register(rf"""WITH {LINES}, m AS (SELECT *, length(text) AS n, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 AS low FROM pages)
    SELECT document_id, count(*) AS page_count, CAST(sum(n) AS BIGINT) AS char_count, avg(n) AS avg_chars, coalesce(array_to_string(list(page_no ORDER BY page_no) FILTER (low), ','), '') AS low_text_pages,
        CAST(least(1.0, avg(n) / 800.0) AS DOUBLE) AS quality_score FROM m GROUP BY document_id""")
def page_quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.quality_rollup(lines(spark, sf_dir))
    return out.select("document_id", "page_count", "char_count", "avg_chars", F.array_join(F.col("low_text_pages").cast("array<string>"), ",").alias("low_text_pages"), "quality_score")


@register(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS solid, CAST(least(8, CASE WHEN length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 100 THEN len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}')) ELSE 8 END) AS BIGINT) AS readable_words,
    CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE least(1.0, length(text) / 800.0) END AS DOUBLE) AS page_score FROM documents""")
def text_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.metrics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")).cast("long").alias("solid"), m["readable_words"].cast("long").alias("readable_words"), quality.page_score(F.col("text")).alias("page_score"))


@register(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]*)["'']?[^>]*>(?:.*?)</a>', 1) AS h FROM pages),
    e AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM a)
    SELECT page_id, href, CAST(min(pos) AS BIGINT) AS pos FROM e WHERE href <> '' GROUP BY page_id, href""")
def html_links_ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_links(table(spark, sf_dir, "pages")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@register(f"WITH {TURNS} SELECT document_id, sha256(string_agg('<!-- page: ' || page_no || ' -->' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_no)) AS digest FROM pages GROUP BY document_id")
def full_text_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.full_text(turns(spark, sf_dir), markers=True).select("document_id", F.sha2("full_text", 256).alias("digest"))


def _sections_sql(sections: dict) -> str:
    return ", ".join("CASE WHEN regexp_matches(body, '{}') THEN '{}' END".format("|".join(f"(?:{p})" for p in ps).replace("'", "''"), name) for name, ps in sections.items())


@register(rf"""WITH {LINES}, b AS (SELECT document_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, lower(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM pages),
    s AS (SELECT document_id, n, list_filter([{_sections_sql(documents.PROSPECTUS_SECTIONS)}], lambda x: x IS NOT NULL) AS s FROM b),
    g AS (SELECT document_id, count(*) AS page_count, sum(n) AS chars, list_sort(list_distinct(flatten(list(s)))) AS m FROM s GROUP BY document_id)
    SELECT document_id, page_count, CAST(chars AS BIGINT) AS extracted_chars, array_to_string(m, '|') AS matched_sections,
        CASE WHEN page_count <= 15 THEN 'rejected_short_document' WHEN page_count < 50 THEN 'needs_review_too_few_pages'
             WHEN list_contains(m, 'offering_title') AND list_contains(m, 'risk_factors') AND len(m) >= 4 THEN 'complete'
             WHEN page_count >= 60 AND chars < page_count * 100 THEN 'needs_ocr' ELSE 'needs_review_missing_sections' END AS status FROM g""")
def section_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.completeness(lines(spark, sf_dir), "prospectus")
    return out.select("document_id", "page_count", "extracted_chars", joined("matched_sections"), "status")


@register(rf"""WITH {LINES}, b AS (SELECT document_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, lower(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM pages),
    s AS (SELECT document_id, n, list_filter([{_sections_sql(documents.ANNUAL_SECTIONS)}], lambda x: x IS NOT NULL) AS s FROM b),
    g AS (SELECT document_id, count(*) AS page_count, sum(n) AS chars, list_sort(list_distinct(flatten(list(s)))) AS m FROM s GROUP BY document_id)
    SELECT document_id, page_count, CAST(chars AS BIGINT) AS extracted_chars, array_to_string(m, '|') AS matched_sections,
        CASE WHEN page_count <= 5 THEN 'rejected_short_document' WHEN page_count < 30 THEN 'needs_review_too_few_pages'
             WHEN list_has_all(m, ['auditor_report', 'notes', 'financial_position', 'profit_or_loss']) THEN 'complete'
             WHEN page_count >= 60 AND chars < page_count * 100 THEN 'needs_ocr' ELSE 'needs_review_missing_sections' END AS status FROM g""")
def section_completeness_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for annual reports."""
    out = documents.completeness(lines(spark, sf_dir), "annual_report")
    return out.select("document_id", "page_count", "extracted_chars", joined("matched_sections"), "status")
