"""Evidence retrieval over search hits: merge, adjacent pages, quota selection, budgets, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, text_of

# Priority and quota of evidence types, in the order in which they are visited.
TYPES = {
    "biography": (105, 4),
    "accounting_policy": (100, 4),
    "net_revenue": (95, 2),
    "user_query": (45, 2),
    "revenue_breakdown": (90, 3),
    "cost_of_revenues": (85, 2),
    "expense_note": (85, 2),
    "mda": (80, 2),
    "kpi_driver": (75, 2),
    "segment_note": (65, 1),
    "critical_estimate": (55, 1),
    "incentive": (50, 2),
    "policy_section": (30, 1),
    "adjacent": (20, 0),
}
BIOGRAPHY_CUES = ("出生", "毕业", "学历", "学士", "硕士", "博士", "历任", "工作经历", "aged", "degree", "graduated", "obtained", "prior to joining", "experience", "served as", "worked at")
# Fixed values: (type, queries of which one matched, points).
QUERY_POINTS = (
    ("accounting_policy", ("transacting user incentives",), 60),
    ("accounting_policy", ("transacting users incentives",), 60),
    ("accounting_policy", ("not in exchange for a distinct good or service",), 80),
    ("accounting_policy", ("revenue recognition", "收入确认"), 40),
    ("revenue_breakdown", ("disaggregation of revenue", "revenue by segment", "revenue by products and services", "营业收入分行业", "营业收入分产品", "主营业务分行业", "主营业务分产品"), 80),
    ("revenue_breakdown", ("major products and services", "主要产品和服务"), 50),
    ("expense_note", ("expenses by nature",), 80),
    ("expense_note", ("promotion advertising user incentives",), 40),
    ("cost_of_revenues", ("courier incentives",), 60),
    ("cost_of_revenues", ("cost of revenues",), 30),
    ("net_revenue", ("deducted from revenues",), 60),
    ("mda", ("management discussion and analysis",), 40),
    ("kpi_driver", ("number of on-demand delivery transactions",), 60),
    ("kpi_driver", ("gtv",), 50),
    ("segment_note", ("segment information", "operating segments", "reportable segments", "分部信息", "经营分部", "报告分部"), 80),
)
PAGE = ["document_id", "page_no"]


def merge(hits: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row for each page: the queries and types that hit it, sorted, and the snippets. hits: keys, query, evidence_type, snippet."""
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_set("query")).alias("matched_queries"), F.sort_array(F.collect_set("evidence_type")).alias("evidence_types"), F.sort_array(F.collect_list("snippet")).alias("snippets"))


def with_adjacent(merged: DataFrame, pages: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The merged hits and the pages before and after them that exist and are no hits themselves, marked is_adjacent."""
    lead = keys[:-1]
    near = merged.select(*lead, "matched_queries", F.explode(F.array(F.col("page_no") - 1, F.col("page_no") + 1)).alias("page_no")).where("page_no > 0")
    near = near.join(merged.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("matched_queries")))).alias("matched_queries"))
    near = near.join(pages.select(*PAGE).distinct(), PAGE, "left_semi").withColumns({"evidence_types": F.array(F.lit("adjacent")), "snippets": F.array().cast("array<string>"), "is_adjacent": F.lit(True)})
    return merged.withColumn("is_adjacent", F.lit(False)).unionByName(near)


def priority(types: Column) -> Column:
    table = F.create_map(*[x for k, (p, _) in TYPES.items() for x in (F.lit(k), F.lit(p))])
    return F.coalesce(F.array_max(F.transform(types, lambda t: F.coalesce(table[t], F.lit(0)))), F.lit(0))


def best_type(types: Column) -> Column:
    """The type of the highest priority; the first by name among equals."""
    table = F.create_map(*[x for k, (p, _) in TYPES.items() for x in (F.lit(k), F.lit(p))])
    ranked = F.array_sort(F.transform(types, lambda t: F.struct((-F.coalesce(table[t], F.lit(0))).alias("p"), t.alias("t"))))
    return F.coalesce(F.get(ranked, F.lit(0))["t"], F.lit("page"))


def type_points(kind: Column, queries: Column, snippets: Column) -> Column:
    matched = F.transform(queries, lambda q: F.lower(q))
    joined = F.lower(F.array_join(snippets, " "))
    cues = sum((F.when(joined.contains(c), 35).otherwise(0) for c in BIOGRAPHY_CUES), F.lit(0)) + F.when(F.length(joined) >= 120, 20).otherwise(0)
    points = F.when(kind == "biography", cues).otherwise(0)
    for name, names, score in QUERY_POINTS:
        points = points + F.when((kind == name) & F.arrays_overlap(matched, F.array(*map(F.lit, names))), score).otherwise(0)
    ended = F.when(joined.contains("year ended"), 120).otherwise(0) - F.when(joined.contains("fourth quarter"), 40).otherwise(0)
    return points + F.when(kind == "segment_note", ended).otherwise(0)


def select_diverse(hits: DataFrame, most: int, group: list[str] = ["query_group"], keys: list[str] = PAGE) -> DataFrame:  # noqa: B006
    """At most `most` pages for each group, with their place in the order of selection.

    Types are visited in a fixed order and give their best pages up to a quota, counting pages taken before; then the best of
    all remaining fill up. As ranks: a page's first place is the least (type, rank in type) within quota, else its overall rank.
    """
    order = F.create_map(*[x for i, k in enumerate(TYPES) for x in (F.lit(k), F.lit(i))])
    quota = F.create_map(*[x for k, (_, q) in TYPES.items() for x in (F.lit(k), F.lit(q))])
    ranked = hits.withColumns({"_priority": priority(F.col("evidence_types")), "_direct": F.when(F.col("is_adjacent"), 0).otherwise(1), "_n": F.size("matched_queries")})
    best = [F.desc("_priority"), F.desc("_direct"), F.desc("_n"), *keys]
    ranked = ranked.withColumn("_overall", F.row_number().over(Window.partitionBy(*group).orderBy(*best)))
    typed = ranked.withColumn("_type", F.explode("evidence_types")).withColumn("_points", type_points(F.col("_type"), F.col("matched_queries"), F.col("snippets")))
    typed = typed.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_type").orderBy(F.desc("_points"), F.desc("_direct"), F.desc("_n"), F.desc("_priority"), "_overall")))
    in_quota = F.when(F.col("_rank") <= F.coalesce(quota[F.col("_type")], F.lit(0)), F.struct(order[F.col("_type")].alias("t"), F.col("_rank").alias("r")))
    plain = [c for c in hits.columns if c not in group + keys]
    placed = typed.withColumn("_slot", F.coalesce(in_quota, F.struct(F.lit(len(TYPES)).alias("t"), F.col("_overall").alias("r")))).groupBy(*group, *keys).agg(F.min("_slot").alias("_slot"), *[F.first(c).alias(c) for c in plain])
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_slot", *keys))).where(F.col("place") <= most).drop("_slot")


def budget(items: DataFrame, most_chars: int, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Texts in order while their characters sum up to less than most_chars; the one that crosses is cut and flagged."""
    size = F.length(text_of(F.col(text)))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = items.withColumn("_before", before).where(F.col("_before") < most_chars)
    left = (most_chars - F.col("_before")).cast("int")
    return out.withColumn("truncated", size > left).withColumn(text, F.substring(text_of(F.col(text)), F.lit(1), left)).drop("_before")


def page_budget(items: DataFrame, most_chars: int, most_pages: int, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """First each text to its share of the budget, then the budget over all."""
    share = min(2500, most_chars // max(1, most_pages))
    return budget(items.withColumn(text, F.substring(text_of(F.col(text)), 1, share)), most_chars, group, order, text)


def interleave(items: DataFrame, group: list[str], order: list[str], list_col: str = "document_id", keys: list[str] = PAGE) -> DataFrame:
    """Round-robin over the lists of each group: first the first of each, in the order of the lists, then the second. A page offered twice counts in its first list."""
    once = items.withColumn("_seen", F.row_number().over(Window.partitionBy(*group, *keys).orderBy(list_col, *order))).where("_seen = 1").drop("_seen")
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy(*group, list_col).orderBy(*order)))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("turn", list_col)))


def useful_adjacent(text: Column, page_no: Column) -> Column:
    return (page_no > 1) & (F.length(F.trim(F.regexp_replace(text_of(text), r"\s+", " "))) >= 200)


def around_matches(text: Column, queries: Column, longest: Column) -> Column:
    """search.excerpt with the terms of the row: `longest` characters around the first of its queries found (its longest word, where the query itself is not there), with ... where cut."""
    body, low = text_of(text), F.lower(text_of(text))

    def places(query):
        words = F.filter(F.array_distinct(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))), lambda w: F.length(w) >= 3)
        ranked = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
        return F.transform(F.filter(F.concat(F.array(query), ranked), lambda t: t != ""), lambda t: F.position(t, low))

    asked = F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda q: F.lower(F.trim(text_of(q))))
    found = F.filter(F.flatten(F.transform(asked, places)), lambda p: p > 0)
    hit = F.coalesce(F.get(found, F.lit(0)), F.lit(0))
    end = F.least(F.length(body), F.greatest(F.lit(0), hit - 1 - F.floor(longest / 3).cast("int")) + longest)
    start = F.greatest(F.lit(0), end - longest)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(body, start + 1, longest), F.when(end < F.length(body), "...").otherwise(""))
    return F.when(F.length(body) <= longest, body).when(hit == 0, F.substring(body, F.lit(1), longest)).otherwise(cut)


def excerpt_budget(items: DataFrame, most_chars: int, page_chars: int, group: list[str], order: list[str], queries: str = "matched_queries", text: str = "text") -> DataFrame:
    """An excerpt of each text around its queries, in order while their characters sum up to less than most_chars; the one that crosses gets a shorter excerpt and is flagged."""
    full = around_matches(F.col(text), F.col(queries), F.lit(page_chars))
    sized = items.withColumn("_size", F.length(full))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sized.withColumn("_left", (most_chars - before).cast("int")).where(F.col("_left") > 0)
    short = around_matches(F.col(text), F.col(queries), F.least(F.lit(page_chars), F.col("_left")))
    return out.withColumn("truncated", F.col("_size") > F.col("_left")).withColumn(text, short).drop("_size", "_left")


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_of(text)) / 3))


def wants(query: Column, hints: tuple[str, ...]) -> Column:
    return contains_any(F.lower(text_of(query)), hints)


def combine_packets(first: DataFrame, more: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Pages of both packets; for a page in both, the later text with the earlier id and place. Places of added pages follow the largest earlier one. Columns: keys, evidence_id, place, text."""
    after = first.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("_after"))
    a, b = first.alias("a"), more.crossJoin(F.broadcast(after)).alias("b")  # one row
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.coalesce("a.evidence_id", "b.evidence_id").alias("evidence_id"), F.coalesce("a.place", F.col("b.place") + F.col("b._after")).alias("place"), F.coalesce("b.text", "a.text").alias("text"))
