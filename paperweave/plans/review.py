"""Plan and review: claims with dependencies, facts with evidence, status roll-ups. Plans are small; facts are rows of any number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of

MOST_CLAIMS, MOST_QUERIES, MOST_DOCUMENTS = 30, 20, 8
SEVERITY = ("invalid", "unlinked", "context_mismatch", "discrepancy", "calculated", "verified")


def conflicts(facts: DataFrame, key: list[str]) -> DataFrame:
    """Facts of one key, period, unit and scope (case does not count) with more than one value and more than one evidence id."""
    folded = facts.select(*[F.lower(F.trim(text_of(F.col(k)))).alias(k) for k in key], "value", "evidence_id")
    return folded.groupBy(*key).agg(F.countDistinct("value").alias("n_values"), F.countDistinct("evidence_id").alias("n_evidence"), F.min("value").alias("least"), F.max("value").alias("most")).where("n_values > 1 and n_evidence > 1")


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), status), F.lit(0))


def roll_up(statuses: DataFrame, group: list[str]) -> DataFrame:
    """The worst status decides; a set is verified only if all are, otherwise calculated."""
    return statuses.groupBy(*group).agg(F.count("*").alias("n"), F.min(severity(F.col("status"))).alias("_worst")).withColumn("status", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("_worst").cast("int"))).drop("_worst")


def binding_status(variables: DataFrame, group: list[str], status: str = "source_status") -> DataFrame:
    """failed if any is not found, verified if all are matched, not_checked if any is left, else not_applicable."""
    s = F.col(status)
    relevant = s != "not_applicable"
    return variables.groupBy(*group).agg(
        F.when(F.bool_or(s == "not_found"), "failed").when(F.coalesce(F.bool_and(F.when(relevant, s == "matched")), F.lit(False)), "verified").when(F.bool_or(relevant), "not_checked").otherwise("not_applicable").alias("source_binding_status")
    )


def layer_of(claims: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Layer by layer, claims whose dependencies are all in earlier layers; -1 for claims on or behind a cycle. Dependencies on unknown ids do not count."""
    open_of = {name: set(deps) & {n for n, _ in claims} - {name} for name, deps in claims}
    out, layer = {}, 0
    while ready := [n for n, deps in open_of.items() if not deps]:
        for n in ready:
            del open_of[n]
        for deps in open_of.values():
            deps.difference_update(ready)
        out |= dict.fromkeys(ready, layer)
        layer += 1
    return out | dict.fromkeys(open_of, -1)


def layers(claims: DataFrame, plan: str = "plan_id") -> DataFrame:
    """(plan, claim_id, layer) for plans of any number; each plan is small by contract. claims: plan, claim_id, depends_on array<string>."""
    @F.pandas_udf("map<string,int>")
    def solve(ids: pd.Series, deps: pd.Series) -> pd.Series:
        return pd.Series([layer_of([(i, list(d) if d is not None else []) for i, d in zip(a, b, strict=True)]) for a, b in zip(ids, deps, strict=True)])

    rows = claims.groupBy(plan).agg(F.sort_array(F.collect_list(F.struct("claim_id", "depends_on"))).alias("c"))
    solved = rows.select(plan, solve(F.col("c.claim_id"), F.col("c.depends_on")).alias("m"))
    return solved.select(plan, F.explode("m").alias("claim_id", "layer"))


def fair_share(claims: DataFrame, total: int, cap: int, group: list[str], order: list[str], need: str) -> DataFrame:
    """Each claim in turn gets at most min(cap, what is left / claims left); what it does not need rolls on. A fold over the claims of one plan."""
    row = F.struct(*[F.col(c) for c in [*order, *[x for x in claims.columns if x not in group + order]]])
    packed = claims.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("_claims"))
    n = F.size("_claims")
    start = F.struct(F.lit(total).cast("long").alias("left"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("given"))

    def step(a, x):
        share = F.least(F.lit(cap).cast("long"), F.floor(a["left"] / F.greatest(F.lit(1), n - a["i"])).cast("long"))
        got = F.least(share, x[need].cast("long"))
        return F.struct((a["left"] - got).alias("left"), (a["i"] + 1).alias("i"), F.concat(a["given"], F.array(got)).alias("given"))

    given = packed.withColumn("_given", F.aggregate("_claims", start, step, lambda a: a["given"]))
    return given.select(*group, F.posexplode("_claims").alias("_at", "_c"), "_given").select(*group, "_c.*", F.element_at("_given", F.col("_at") + 1).alias("granted"))


def evidence_ids(items: DataFrame, prior: DataFrame, group: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """claim:eN for each page: the id it had before, else the next number not yet used in its claim. prior: group, keys, evidence_id."""
    used = prior.groupBy(*group).agg(F.max(F.regexp_extract("evidence_id", ":e([0-9]+)$", 1).try_cast("int")).alias("_used"))
    known = items.join(prior.select(*group, *keys, "evidence_id"), [*group, *keys], "left").join(used, group, "left")
    fresh = F.sum(F.when(F.col("evidence_id").isNull(), 1).otherwise(0)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    number = F.coalesce("_used", F.lit(0)) + fresh
    return known.withColumn("evidence_id", F.coalesce("evidence_id", F.concat_ws(":e", F.col(group[0]).cast("string"), number.cast("string")))).drop("_used")


def check_evidence(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts with `known`: whether their evidence id is registered for their claim."""
    ids = registry.select(F.col("claim_id"), F.col("evidence_id"), F.lit(True).alias("known")).distinct()
    return facts.join(ids, ["claim_id", "evidence_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def normalise_plan(plan: dict) -> dict:
    """A checked copy of a plan: {"claims": [{"claim_id", "question", "depends_on_claim_ids", "search_queries"}]}; ValueError says what is wrong."""
    import re

    claims, out, seen = plan.get("claims"), [], set()
    if not isinstance(claims, list) or not 0 < len(claims) <= MOST_CLAIMS:
        raise ValueError(f"a plan has 1 to {MOST_CLAIMS} claims")
    for i, claim in enumerate(claims, 1):
        name = re.sub(r"[^0-9A-Za-z_.-]+", "_", str(claim.get("claim_id") or f"claim_{i}"))[:80]
        if name in seen:
            raise ValueError(f"claim {name} occurs twice")
        seen.add(name)
        queries = list(dict.fromkeys(" ".join(str(q).split()) for q in claim.get("search_queries") or [] if str(q).strip()))[:MOST_QUERIES]
        if not str(claim.get("question") or "").strip() or not queries:
            raise ValueError(f"claim {name} needs a question and search queries")
        out.append({"claim_id": name, "question": str(claim["question"]).strip(), "depends_on_claim_ids": list(dict.fromkeys(claim.get("depends_on_claim_ids") or [])), "search_queries": queries})
    for claim in out:
        for other in claim["depends_on_claim_ids"]:
            if other not in seen or other == claim["claim_id"]:
                raise ValueError(f"claim {claim['claim_id']} depends on {other}, which is no other claim")
    return {"claims": out}
