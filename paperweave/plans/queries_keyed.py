"""Registered queries on keyed tables over time, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, lifecycle
from ..session import shared_dir
from ..sources import readers
from ..streaming import events as streaming
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


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@register(f"""SELECT event_id, CASE WHEN {NOW} > ts + to_seconds(CAST(86400 * (event_id % 20) AS BIGINT)) OR date_diff('second', ts, {NOW}) > 1000000 THEN 'stale' ELSE 'hit' END AS cache_status FROM events""")
def ttl_cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a cached answer with its own time to live, seen at one moment."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    expires = F.expr("ts + make_interval(0, 0, 0, cast(event_id % 20 as int))")
    return table(spark, sf_dir, "events").select("event_id", lifecycle.freshness(now, F.col("ts"), expires, 1_000_000).alias("cache_status"))


@register("""SELECT lower(event_type) || '|' || user_id AS source_key, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS times_seen, min({ts: ts, e: event_id}).e AS first_event, max({ts: ts, v: value}).v AS last_value
    FROM events GROUP BY lower(event_type) || '|' || user_id""")
def source_upsert_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(lifecycle.source_key(F.col("event_type"), F.lit(""), F.col("user_id")).alias("source_key"), "ts", F.col("event_id").alias("first_event"), F.col("value").alias("last_value"))
    return lifecycle.merge_sources(e, "source_key", "ts", ["first_event"], ["last_value"])


@register("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type", "value")


_LAST = "SELECT user_id, event_id, event_type, value FROM events WHERE event_type {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@register(f"""WITH old AS ({_LAST.format("= 'view'")}), new AS ({_LAST.format("<> 'view'")})
    SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.event_id ELSE n.event_id END AS event_id, o.event_type AS event_type, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value
    FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def upsert_supplied_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last views, overwritten by the last other event, but for the type, which the new rows do not supply."""
    e, last = table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")]
    old = lifecycle.latest(e.where("event_type = 'view'"), ["user_id"], last).select("user_id", "event_id", "event_type", "value")
    new = lifecycle.latest(e.where("event_type <> 'view'"), ["user_id"], last).select("user_id", "event_id", "value")
    return lifecycle.upsert(old, new, ["user_id"])


@register("""WITH r AS (SELECT event_id, CASE WHEN user_id < 50 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS title, event_type FROM events),
    old AS (SELECT * FROM r WHERE event_type <> 'purchase'), new AS (SELECT * FROM r WHERE event_type = 'purchase')
    SELECT event_id, symbol, title, event_type FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE coalesce(new.symbol, '') = coalesce(old.symbol, '') AND new.title = old.title) UNION ALL SELECT event_id, symbol, title, event_type FROM new""")
def filing_nullsafe_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") >= 50, F.col("user_id").cast("string")).alias("symbol"), F.to_date("ts").cast("string").alias("title"), "event_type")
    return lifecycle.replace_null_safe(r.where("event_type <> 'purchase'"), r.where("event_type = 'purchase'"), ["symbol", "title"])


@register("""SELECT doc_id, md5(text) AS digest, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY md5(text)) QUALIFY n > 1""")
def duplicate_groups_size_then_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member of a group of equal texts, with the group's size and first member: groups may be of any size."""
    return lifecycle.duplicate_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.md5("text"), "doc_id")


@register("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations)")
def unreferenced_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = [table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))]
    return lifecycle.unreferenced(table(spark, sf_dir, "documents").select("doc_id", "source"), refs, "doc_id")


@register("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS k, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, CAST(1 + o_orderkey % 7 AS BIGINT) AS declared, coalesce(n_lines, 0) AS n_lines, coalesce(n_returned, 0) AS n_returned, coalesce(n_lines, 0) = 1 + o_orderkey % 7 AND coalesce(n_returned, 0) = 1 + o_orderkey % 7 AS consistent
    FROM orders LEFT JOIN l ON l.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey""")
def consistency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).cast("long").alias("n"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return lifecycle.consistency(o, {"n_lines": lines, "n_returned": lines.where("l_returnflag = 'R'")}, "o_orderkey", "n")


@register("""WITH i AS (SELECT conv_id * 1000 + turn AS row_no, role, lower(coalesce(text, '')) AS body FROM conversations)
    SELECT row_no, CASE WHEN min(row_no) OVER w <> row_no THEN min(row_no) OVER w ELSE -1 END AS deduplicated_from_row FROM i WINDOW w AS (PARTITION BY coalesce(role, ''), body)""")
def batch_dedup_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one role and one text, whatever its case, share their work."""
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"), "role", F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256).alias("body"))
    return lifecycle.batch_plan(items, ["role", "body"], "row_no").select("row_no", F.coalesce("deduplicated_from_row", F.lit(-1)).alias("deduplicated_from_row"))


@register("""WITH p AS (SELECT event_type AS status, min(event_id) OVER (PARTITION BY user_id, event_type) AS lead, event_id FROM events)
    SELECT status, count(*) AS n, count(*) FILTER (lead <> event_id) AS n_deduplicated FROM p GROUP BY status""")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("status"))
    return lifecycle.batch_summary(lifecycle.batch_plan(e, ["user_id", "status"], "event_id"), "status")


@register("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"))
    return lifecycle.resume(table(spark, sf_dir, "events").select("event_id", "user_id"), done, "event_id")


@register("""WITH a AS (SELECT l_partkey AS path, l_suppkey AS owner FROM lineitem UNION ALL SELECT p_partkey, p_partkey FROM part)
    SELECT path, count(*) AS n_references, count(DISTINCT owner) AS n_owners, min(owner) AS first_owner FROM a GROUP BY path HAVING count(DISTINCT owner) > 1""")
def union_all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("owner"))
    return lifecycle.shared_references([lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("owner"))], "path", "owner")


@register("""WITH c AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, event_type FROM events),
    l AS (SELECT user_id, max(event_type) AS event_type, '' AS k FROM events WHERE event_type <> 'view' GROUP BY user_id)
    SELECT event_id, c.user_id, c.k, coalesce(l.event_type, c.event_type) AS event_type FROM c LEFT JOIN l ON l.user_id = c.user_id""")
def json_payload_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the payload, overridden by what a linked row gives, unless that is blank."""
    e = table(spark, sf_dir, "events")
    cached = e.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    linked = e.where("event_type <> 'view'").select("user_id", "event_type", F.lit("").alias("k"))
    return lifecycle.override(cached, linked, "user_id", ["k", "event_type"], ["event_type"])


@register("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
    SELECT 'documents' AS table_name, count(*) AS n_deleted FROM documents WHERE doc_id IN (FROM g) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (FROM g) UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE conv_id IN (FROM g)""")
def delete_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table a clean-up of the toxic documents would delete."""
    labels = table(spark, sf_dir, "labels")
    tables = {"documents": table(spark, sf_dir, "documents").select("doc_id"), "labels": labels.select("doc_id"), "conversations": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))}
    return lifecycle.delete_cascade(tables, labels.where("toxic = 1"), "doc_id")[1]


@register("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN toxic = 1 THEN 'forced_overwrite' WHEN length(text) = 0 THEN 'corrupt_cache' WHEN quality = 0 THEN 'stale_missing_hash'
    WHEN lang <> 'en' THEN 'stale_hash_mismatch' ELSE 'hit' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    stored = F.when(F.col("quality") == 0, "").otherwise("en")
    return d.select("doc_id", lifecycle.ingest_status(F.col("quality").isNotNull(), stored, F.col("lang"), F.col("toxic") == 1, F.length("text") > 0).alias("status"))


@register("""WITH b AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS branch FROM events)
    SELECT user_id, event_id, CAST(branch AS BIGINT) AS branch FROM b QUALIFY branch = min(branch) OVER (PARTITION BY user_id)""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the purchases, else the clicks, else all other events."""
    e = table(spark, sf_dir, "events")
    branches = [e.where(c).select("user_id", "event_id") for c in ("event_type = 'purchase'", "event_type = 'click'", "event_type not in ('purchase', 'click')")]
    return lifecycle.fallback(branches, ["user_id"]).select("user_id", "event_id", F.col("branch").cast("long").alias("branch"))


@register("SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem QUALIFY l_shipdate = max(l_shipdate) OVER (PARTITION BY l_suppkey)")
def latest_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return readers.latest_group(rows, ["l_suppkey"], "l_shipdate")


@register("""SELECT c_custkey, 'c_mktsegment' AS item, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer""")
def profile_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.unpivot_profile(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", F.col("c_nationkey").cast("string").alias("nation")), ["c_custkey"])


@register("""WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS page_no, 'e' || turn AS evidence_id, turn AS place, role AS text FROM conversations WHERE role = 'user'),
    b AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS page_no, 'x' || turn AS evidence_id, turn AS place, text FROM conversations WHERE length(text) > 200)
    SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page_no, b.page_no) AS page_no, coalesce(a.evidence_id, b.evidence_id) AS evidence_id, coalesce(a.place, b.place + (SELECT max(place) + 1 FROM a)) AS place, coalesce(b.text, a.text) AS text
    FROM a FULL JOIN b ON a.document_id = b.document_id AND a.page_no = b.page_no""")
def packet_merge_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    packet = lambda rows, mark, text: rows.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page_no"), F.concat(F.lit(mark), F.col("turn").cast("string")).alias("evidence_id"), F.col("turn").alias("place"), F.col(text).alias("text"))
    return evidence.combine_packets(packet(c.where("role = 'user'"), "e", "role"), packet(c.where("length(text) > 200"), "x", "text"))


@register("SELECT n_name AS market, c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) <= 10")
def filtered_top_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunctive filter pushed to the scan, the ten first of each market."""
    from ..operators.filings import search_sources

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("market"))
    wide = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("a").alias("market"), F.col("market").alias("nation"), "c_custkey", "c_name", "c_acctbal", "segment")
    found = search_sources(wide, "A", 10, [F.desc("c_acctbal"), F.col("c_custkey")], within=["nation"], segment="BUILDING")
    return found.select(F.col("nation").alias("market"), "c_custkey", "c_name", "c_acctbal")


@register("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, each id once, appended to a table and counted."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    streaming.run_once(streaming.once_each(streaming.read_events(spark, sf_dir)), f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("event_type").agg(F.count("*").alias("n"))
