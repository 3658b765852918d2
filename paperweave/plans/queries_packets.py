"""Registered queries on the query language, postings, evidence packets, plans and reviews, each with its SQL. Conversations stand for paged documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, packets, search
from ..session import shared_dir
from .queries_search import LINES, TURNS, kept_lines, kept_turns, table, turns, word_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@register(rf"""WITH {LINES} SELECT document_id, count(*) AS pages, CAST(sum(len(list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))) AS BIGINT) AS tokens FROM pages GROUP BY document_id""")
def page_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all lines, made here if no query before made it: pages and tokens of each document."""
    return kept_lines(spark, sf_dir).table("pages").groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("n").alias("tokens"))


@register(r"""WITH pages AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') || CASE WHEN quality = 1 THEN ' Reviewed twice' ELSE '' END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0),
    t AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(document_id || ' ' || text)), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS token FROM pages)
    SELECT token, count(*) AS df FROM t GROUP BY token""")
def page_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, then brought up to date: good documents get a few more words, toxic ones leave. In how many pages each token is afterwards."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    page = [F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_no")]
    path = f"{shared_dir(spark)}/page-index-{uuid.uuid4().hex}"
    index.update(spark, path, docs.select(*page, "text"))
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").select(*page, F.concat(F.coalesce("text", F.lit("")), F.lit(" Reviewed twice")).alias("text"))
    after = index.update(spark, path, good, labels.where("toxic = 1").select(F.col("doc_id").alias("document_id")))
    index.vacuum(after)  # nobody else knows this index
    return after.table("blocks").groupBy("token").agg(F.sum("df").alias("df"))


GRAMMAR = [("g1", "the tion*"), ("g2", "und OR que"), ("g3", "of NOT the"), ("g4", '"in the"'), ("g5", "p&l"), ("g6", '"open')]


@register(rf"""WITH {TURNS}, t AS (SELECT document_id, page_no, lower(text) AS low, list_filter(regexp_split_to_array(strip_accents(lower(document_id || ' ' || text)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS h FROM pages)
    SELECT 'g1' AS query_id, document_id, page_no FROM t WHERE list_contains(h, 'the') AND len(list_filter(h, lambda x: starts_with(x, 'tion'))) > 0
    UNION ALL SELECT 'g2', document_id, page_no FROM t WHERE list_contains(h, 'und') OR list_contains(h, 'que') UNION ALL SELECT 'g3', document_id, page_no FROM t WHERE list_contains(h, 'of') AND NOT list_contains(h, 'the')
    UNION ALL SELECT 'g4', document_id, page_no FROM t WHERE contains(' ' || array_to_string(h, ' ') || ' ', ' in the ') UNION ALL SELECT 'g5', document_id, page_no FROM t WHERE contains(low, 'p&l') UNION ALL SELECT 'g6', document_id, page_no FROM t WHERE contains(low, '"open')""")
def search_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings, OR, NOT and phrases; what is no query of the language is searched as a substring."""
    pages = kept_turns(spark, sf_dir)
    hits, plain = index.grammar_hits(pages, GRAMMAR)
    return hits.unionByName(index.substring_hits(pages, plain).select(hits.columns))


TERMS = [("t1", "thing"), ("t2", "tion an"), ("t3", "xyzzy"), ("t4", "Der"), ("t5", "qu")]


@register(f"WITH {LINES}, q(query_id, term) AS (VALUES {', '.join(str(t) for t in TERMS)}) SELECT query_id, document_id, page_no FROM pages, q WHERE contains(lower(text), lower(term))")
def search_trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated terms by their rarest trigrams; one of two letters is searched in the texts."""
    return index.term_hits(kept_lines(spark, sf_dir), TERMS).select("query_id", "document_id", "page_no")


RANKED = [("b1", "the thing of"), ("b2", "und der tion")]


@register(rf"""WITH {TURNS}, q(query_id, query) AS (VALUES {', '.join(str(t) for t in RANKED)}), w AS (SELECT query_id, unnest(string_split(query, ' ')) AS token FROM q),
    h AS (SELECT document_id, page_no, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS h FROM pages), s AS (SELECT count(*) AS n, sum(len(h)) AS total FROM h),
    e AS (SELECT document_id, page_no, len(h) AS n, unnest(h) AS token FROM h), tf AS (SELECT token, document_id, page_no, n, count(*) AS tf FROM e WHERE token IN (SELECT token FROM w) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    r AS (SELECT query_id, document_id, page_no, round(sum(greatest(1e-6, ln((s.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n * s.n / total))), 6) AS score FROM tf JOIN df USING (token) JOIN w USING (token), s GROUP BY ALL)
    SELECT query_id, document_id, page_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page_no) AS rank FROM r QUALIFY rank <= 20""")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best turns of each query by BM25."""
    hits = index.bm25(kept_turns(spark, sf_dir), spark.createDataFrame(RANKED, "query_id string, query string"), 20)
    return hits.select("query_id", "document_id", "page_no", F.col("rank").cast("long").alias("rank"))


def _values(pairs: tuple) -> str:
    return "[" + ", ".join(f"{{'q': '{q}', 't': '{t}'}}" for q, t in pairs) + "]"


_FINANCIAL = f"CASE WHEN contains(low, 'operating segment') OR contains(low, 'revenue model') THEN {_values(packets.BUSINESS_QUERIES)} ELSE {_values(packets.BUSINESS_QUERIES + packets.FINANCIAL_QUERIES)} END"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    topic = F.when(k % 5 == 0, " operating  segments").when(k % 5 == 1, " user incentives").when(k % 5 == 2, "").otherwise(" revenue model")
    question = F.when(k % 7 == 0, "Revenue  Recognition").otherwise(F.concat("p_name", topic))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("question_id"), question.alias("question"), F.when(k % 3 == 0, "accounting_policy").when(k % 3 == 1, "financial_analysis").otherwise("basic").alias("strategy"))


@register(rf"""WITH q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'Revenue  Recognition' ELSE p_name || CASE p_partkey % 5 WHEN 0 THEN ' operating  segments' WHEN 1 THEN ' user incentives' WHEN 2 THEN '' ELSE ' revenue model' END END AS question FROM part),
    l AS (SELECT *, lower(question) AS low FROM q),
    e AS (SELECT k, list_concat([{{'q': question, 't': 'user_query'}}], CASE k % 3 WHEN 0 THEN {_values(packets.ACCOUNTING_QUERIES)} WHEN 1 THEN {_FINANCIAL} ELSE [] END,
        CASE WHEN k % 3 < 2 AND contains(low, 'incentive') THEN {_values(packets.INCENTIVE_QUERIES)} ELSE [] END) AS x FROM l),
    u AS (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS pos FROM e), c AS (SELECT k, pos, trim(regexp_replace(x.q, '\s+', ' ', 'g')) AS query, x.t AS evidence_type FROM u)
    SELECT CAST(k AS VARCHAR) AS question_id, CAST(pos AS BIGINT) AS pos, query, evidence_type FROM c QUALIFY row_number() OVER (PARTITION BY k, lower(query) ORDER BY pos) = 1""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that each question expands to by its strategy."""
    return packets.expand(_questions(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


ASKED = [("q1", "the thing"), ("q2", "und der"), ("q3", "of tion")]
_ASKED = ", ".join(str(t) for t in ASKED)


@register(f"""WITH {TURNS}, {word_sql(f"queries(query_id, query) AS (VALUES {_ASKED})")},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, page_no) AS rank FROM hits QUALIFY rank <= 8), w AS (SELECT r.*, p.text FROM r JOIN pages p USING (document_id, page_no)),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT query_id, document_id, page_no, rank, length(text) > 2000 - before AS truncated, substring(text, 1, CAST(2000 - before AS BIGINT)) AS text FROM s WHERE before < 2000""")
def packet_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight pages of each query within 2,000 characters."""
    pages = turns(spark, sf_dir)
    hits = index.word_hits(kept_turns(spark, sf_dir), spark.createDataFrame(ASKED, "query_id string, query string"))
    return packets.basic(hits, pages, 8, 2000).withColumn("rank", F.col("rank").cast("long"))


@register()
def packet_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of questions whose strategy expands them, over all turns; tested against its parts on stated pages."""
    asked = spark.createDataFrame([("a", "the thing", "basic"), ("b", "user incentives", "accounting_policy"), ("c", "und der", "financial_analysis")], "question_id string, question string, strategy string")
    out = packets.planned(asked, turns(spark, sf_dir), kept=kept_turns(spark, sf_dir))
    return out.select("question_id", "document_id", "page_no", F.col("place").cast("long").alias("place"), F.array_join("matched_queries", "|").alias("matched_queries"), "text", "truncated")


@register("""WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS page_no, count(*) AS n_tables, count(*) FILTER (l_quantity > 40) AS shortened FROM lineitem GROUP BY 1, 2),
    i AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS page_no, CASE WHEN l_orderkey % 2 = 0 THEN 'own' END AS own FROM lineitem WHERE l_linenumber <= 3)
    SELECT i.document_id, i.page_no, CAST(coalesce(n_tables, 0) AS BIGINT) AS n_tables, CAST(coalesce(shortened, 0) AS BIGINT) AS n_shortened, coalesce(own, o_orderstatus) AS company_name, CAST(year(o_orderdate) AS BIGINT) AS report_year
    FROM i LEFT JOIN t USING (document_id, page_no) LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = i.document_id""")
def hits_with_tables_and_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages, each with the tables on it (here one for each line, of as many column paths as its quantity) and its document's meta data."""
    li, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey").cast("string").alias("document_id")
    tables = li.select(key, F.col("l_linenumber").alias("page_no"), F.col("l_suppkey").cast("int").alias("table_index"), F.transform(F.sequence(F.lit(1), F.col("l_quantity").cast("int")), lambda i: i.cast("string")).alias("column_paths"))
    meta = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderstatus").alias("company_name"), F.year("o_orderdate").alias("report_year"))
    items = li.where("l_linenumber <= 3").select(key, F.col("l_linenumber").alias("page_no"), F.when(F.col("l_orderkey") % 2 == 0, "own").alias("company_name")).distinct()
    out = packets.with_tables(items, tables, meta)
    none = F.lit(0).cast("long")
    return out.select("document_id", "page_no", F.coalesce(F.size("tables").cast("long"), none).alias("n_tables"), F.coalesce(F.size(F.filter("tables", lambda t: t["shortened"])).cast("long"), none).alias("n_shortened"), "company_name", F.col("report_year").cast("long").alias("report_year"))


@register(f"""WITH {TURNS}, {word_sql("queries(query_id, query) AS (VALUES ('x', 'the'))")}, d AS (SELECT DISTINCT document_id FROM pages WHERE document_id NOT IN (SELECT document_id FROM hits))
    SELECT document_id, count(*) AS page_count, CAST(count(*) FILTER (CAST(document_id AS BIGINT) % 2 = 0 AND page_no = 1) AS BIGINT) AS garbled_pages, count(*) FILTER (CAST(document_id AS BIGINT) % 2 = 0 AND page_no = 1) >= 0.05 * count(*) AS requires_ocr FROM pages JOIN d USING (document_id) WHERE page_no <= 64 GROUP BY document_id""")
def empty_hit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of conversations without a hit, those whose first pages are garbled (here the first page of every other one)."""
    pages = turns(spark, sf_dir)
    hits = index.word_hits(kept_turns(spark, sf_dir), spark.createDataFrame([("x", "the")], "query_id string, query string"))
    broken = F.when((F.col("document_id").cast("long") % 2 == 0) & (F.col("page_no") == 1), F.lit("A;B>C?D\x01" * 80)).otherwise(F.lit("Some words that can be read and say no more than they should, on every page of this document."))
    return packets.empty_probe(pages.select("document_id").distinct(), hits, pages.withColumn("text", broken))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    number = F.when(F.col("turn") % 5 == 3, "x").when(F.col("turn") % 5 == 4, "-1").otherwise((F.col("turn") % 3 + 1).cast("string"))
    return c.select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("pos"), F.when(F.col("turn") == 2, "other").when(F.col("turn") == 1, F.col("conv_id").cast("string")).alias("document_id"), F.col("conv_id").cast("string").alias("scope"), number.alias("page"))


_REQUESTS = """r AS (SELECT conv_id AS claim_id, turn AS pos, CASE WHEN turn = 2 THEN 'other' ELSE CAST(conv_id AS VARCHAR) END AS document_id, CASE turn % 5 WHEN 3 THEN NULL WHEN 4 THEN -1 ELSE turn % 3 + 1 END AS page_no FROM conversations),
    p AS (SELECT *, CASE WHEN document_id = 'other' THEN 'outside the scope' WHEN page_no IS NULL THEN 'no number' WHEN page_no <= 0 THEN 'not positive' END AS problem FROM r),
    o AS (SELECT * FROM p WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY claim_id, document_id, page_no ORDER BY pos) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS k FROM o)"""


@register(f"WITH {_REQUESTS} SELECT claim_id, document_id, CAST(page_no AS BIGINT) AS page_no, CASE WHEN k > 2 THEN 'too many pages' END AS problem FROM k UNION ALL SELECT claim_id, document_id, page_no, problem FROM p WHERE problem IS NOT NULL")
def expand_page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a review asks for, two at most for each claim, and what is wrong with the others."""
    return packets.expanded_pages(_requests(spark, sf_dir), 2).withColumn("page_no", F.col("page_no").cast("long"))


@register(f"""WITH {TURNS}, {_REQUESTS}, w AS (SELECT k.claim_id, k.document_id, k.page_no, pages.text FROM k JOIN pages ON pages.document_id = k.document_id AND pages.page_no = k.page_no WHERE k <= 12),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY claim_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT claim_id, document_id, CAST(page_no AS BIGINT) AS page_no, length(text) > 600 - before AS truncated, substring(text, 1, CAST(600 - before AS BIGINT)) AS text FROM s WHERE before < 600""")
def expand_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.expanded(_requests(spark, sf_dir), turns(spark, sf_dir), 600).withColumn("page_no", F.col("page_no").cast("long"))


WORDS = ["the thing", "und", "of", "que"]
_PLANS = "c AS (SELECT item_id // 30 AS plan_id, item_id % 30 AS claim_no, (['the thing', 'und', 'of', 'que'])[CAST(item_id % 4 + 1 AS INTEGER)] AS query FROM benchmark)"


@register(f"""WITH RECURSIVE {TURNS}, {_PLANS}, {word_sql("queries AS (SELECT plan_id || '#' || claim_no AS query_id, query FROM c)")},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, page_no) AS rank FROM hits QUALIFY rank <= 3), w AS (SELECT r.*, p.text FROM r JOIN pages p USING (document_id, page_no)),
    need AS (SELECT plan_id, claim_no, plan_id || '#' || claim_no AS query_id, coalesce((SELECT sum(length(text)) FROM w WHERE w.query_id = plan_id || '#' || claim_no), 0) AS need, row_number() OVER (PARTITION BY plan_id ORDER BY claim_no) AS i, count(*) OVER (PARTITION BY plan_id) AS n FROM c),
    f AS (SELECT plan_id, i, query_id, least(900, 4000 // n, need) AS granted, 4000 - least(900, 4000 // n, need) AS rest FROM need WHERE i = 1
        UNION ALL SELECT d.plan_id, d.i, d.query_id, least(900, f.rest // (d.n - d.i + 1), d.need), f.rest - least(900, f.rest // (d.n - d.i + 1), d.need) FROM f JOIN need d ON d.plan_id = f.plan_id AND d.i = f.i + 1),
    s AS (SELECT w.*, granted, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w JOIN f USING (query_id))
    SELECT query_id, document_id, page_no, split_part(query_id, '#', 2) || ':e' || rank AS evidence_id, substring(text, 1, CAST(granted - before AS BIGINT)) AS text, length(text) > granted - before AS truncated FROM s WHERE before < granted""")
def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of all plans in one job, each plan's 4,000 characters shared fairly. Plans have 30 claims at most, and grow in number with the table."""
    b = table(spark, sf_dir, "benchmark")
    claims = b.select(F.floor(F.col("item_id") / 30).alias("plan_id"), (F.col("item_id") % 30).alias("claim_no"), F.element_at(F.array(*map(F.lit, WORDS)), (F.col("item_id") % 4 + 1).cast("int")).alias("query"))
    out = packets.execute(claims, turns(spark, sf_dir), 3, 900, 4000, kept_turns(spark, sf_dir))
    return out.select(F.concat_ws("#", "plan_id", "claim_no").alias("query_id"), "document_id", "page_no", "evidence_id", "text", "truncated")


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    eid = F.concat(F.lit("e"), (F.col("l_suppkey") % 4).cast("string"))
    items = li.where("l_linenumber > 1").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("claim_id"), eid.alias("evidence_id"), F.col("l_returnflag").alias("text"))
    status = F.when(F.col("l_returnflag") == "A", "sufficient").when(F.col("l_returnflag") == "N", "Partial ").when(F.col("l_quantity") > 45, "unsure").otherwise("conflicting")
    ids = F.when(F.col("l_quantity") > 10, F.array(F.concat(F.lit("e"), (F.col("l_suppkey") % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    reviews = li.where("l_linenumber < 4").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("claim_id"), status.alias("status"), ids.alias("evidence_ids"))
    return reviews, packets.registry_of(items).select("plan_id", "claim_id", "evidence_ids")


_REVIEWS = """g AS (SELECT l_orderkey AS plan_id, l_linenumber AS claim_id, list_distinct(list('e' || l_suppkey % 4)) AS given FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2),
    v AS (SELECT l_orderkey AS plan_id, l_linenumber AS claim_id, CASE WHEN l_returnflag = 'A' THEN 'sufficient' WHEN l_returnflag = 'N' THEN 'partial' WHEN l_quantity > 45 THEN 'unsure' ELSE 'conflicting' END AS status, CASE WHEN l_quantity > 10 THEN ['e' || l_suppkey % 5] ELSE [] END AS ids FROM lineitem WHERE l_linenumber < 4),
    w AS (SELECT v.*, given, count(*) OVER (PARTITION BY v.plan_id, v.claim_id) AS n FROM v LEFT JOIN g USING (plan_id, claim_id)),
    problems AS (SELECT plan_id, claim_id, 'repeated claim' AS problem FROM w WHERE n > 1 UNION SELECT plan_id, claim_id, 'unexpected claim' FROM w WHERE given IS NULL UNION SELECT plan_id, claim_id, 'unknown status' FROM w WHERE status = 'unsure'
        UNION SELECT plan_id, claim_id, 'unknown evidence' FROM w WHERE given IS NOT NULL AND len(list_filter(ids, lambda x: NOT list_contains(given, x))) > 0 UNION SELECT plan_id, claim_id, 'no evidence' FROM w WHERE status = 'sufficient' AND len(ids) = 0
        UNION SELECT plan_id, claim_id, 'missing claim' FROM g WHERE (plan_id, claim_id) NOT IN (SELECT (plan_id, claim_id) FROM v) AND plan_id IN (SELECT plan_id FROM v))"""


@register(f"WITH {_REVIEWS} SELECT * FROM problems")
def review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with reviews against the evidence that their claims were given."""
    return packets.review_problems(*_reviews(spark, sf_dir))


@register(f"""WITH {_REVIEWS}, o AS (SELECT plan_id, count(*) FILTER (status <> 'sufficient') AS n_open FROM v GROUP BY plan_id)
    SELECT plan_id, CASE WHEN plan_id IN (SELECT plan_id FROM problems) THEN 'invalid_review' WHEN n_open = 0 THEN 'complete' ELSE 'follow_up' END AS stage, n_open FROM o""")
def plan_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plan does next after its review."""
    reviews, registry = _reviews(spark, sf_dir)
    return packets.continuation(reviews, packets.review_problems(reviews, registry), 1, 2)


@register("""SELECT CAST(l_orderkey AS BIGINT) AS plan_id, l_linenumber AS claim_id, array_to_string(list_sort(list_distinct(list('e' || l_suppkey % 4))), ',') AS evidence_ids, arg_min(l_returnflag, {s: 'e' || l_suppkey % 4, f: l_returnflag}) AS first_text FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2""")
def evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that each claim was given, and the text of its first id."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    items = li.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("claim_id"), F.concat(F.lit("e"), (F.col("l_suppkey") % 4).cast("string")).alias("evidence_id"), F.col("l_returnflag").alias("text"))
    out = packets.registry_of(items)
    return out.select("plan_id", "claim_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.element_at("catalog", F.element_at("evidence_ids", 1)).alias("first_text"))
