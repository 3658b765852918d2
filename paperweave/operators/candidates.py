"""Which filing answers a request: candidates of all requests are tried in rounds, the best untried one of each open request at a time.

A round validates each distinct content once, and not at all where an earlier round or the kept results have it; requests that are
answered leave before the next round, so the work grows with the tries, not with the candidates. Candidates of the wrong variant
are attempts that need no validation. Every round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, text_of
from ..session import unwrite, written

# Titles of the wrong variant of an annual report, by market.
OVERSEAS = ("overseas regulatory announcement", "海外監管公告", "海外监管公告")
H_SHARE = ("h股公告", "港股公告", "h-share announcement")
#: What a validation belongs to: the document, its content, the kind it was validated as, and the company.
MEMO = ["document_id", "sha256", "document_type", "symbol"]
ATTEMPT = "request_id long, candidate_id long, rank int, round int, outcome string, cached boolean"


def source_of(market: Column, document_type: Column) -> Column:
    """The search that answers a request: prospectuses of both markets have one, annual reports and other filings one for each market."""
    kind, side = F.lower(F.trim(text_of(document_type))), F.when(F.upper(text_of(market)).startswith("H"), "h").otherwise("a")
    return F.when(kind == "prospectus", F.lit("prospectus")).when(kind == "annual_report", F.concat(side, F.lit("_annual_report"))).otherwise(F.concat(side, F.lit("_filings")))


def wrong_variant(market: Column, document_type: Column, title: Column) -> Column:
    """Why a candidate cannot be the annual report asked, or null."""
    low = F.trim(F.regexp_replace(F.lower(text_of(title)), r"\s+", " "))
    side, annual = F.upper(text_of(market)), F.lower(F.trim(text_of(document_type))) == "annual_report"
    return F.when(annual & side.startswith("H") & contains_any(low, OVERSEAS), "overseas regulatory announcement").when(annual & side.startswith("A") & contains_any(low, H_SHARE), "H-share announcement")


def address(pdf_url: Column, detail_url: Column) -> Column:
    return F.coalesce(F.nullif(pdf_url, F.lit("")), F.nullif(detail_url, F.lit("")))


def tryable(url: Column, document_type: Column) -> Column:
    """A PDF, or a prospectus that is listed in parts on one page."""
    low = F.lower(text_of(url))
    return low.endswith(".pdf") | ((F.lower(F.trim(text_of(document_type))) == "prospectus") & low.rlike(r"\.html?$"))


def locate(candidates: DataFrame, validate: Callable[[DataFrame], DataFrame], kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted candidates (request_id, candidate_id, round), all attempts (see ATTEMPT), and the validations to keep (MEMO, complete, passed).

    candidates: request_id, candidate_id, rank (of any type with an order, least first; ties by candidate_id), problem (null, or why it is no real candidate), and MEMO. validate
    takes distinct rows of MEMO and returns them with complete and passed (booleans). A candidate is accepted if both hold. Of
    the kept validations only those with both are used again; others are made anew.
    """
    spark = candidates.sparkSession
    order = Window.partitionBy("request_id").orderBy("rank", "candidate_id")
    rows = candidates.select("request_id", "candidate_id", F.row_number().over(order).alias("rank"), "problem", *MEMO)
    # A candidate with a problem is an attempt if the request came that far; `step` counts the real ones, which rounds take one by one.
    real = F.col("problem").isNull().cast("int")
    rows = written(rows.withColumn("step", F.sum(real).over(Window.partitionBy("request_id").orderBy("rank"))), "candidates")
    none = spark.createDataFrame([], "request_id long, candidate_id long, rank int, round int, complete boolean, passed boolean, cached boolean")
    known = kept.where("complete and passed").select(*MEMO, "complete", "passed").distinct() if kept is not None else spark.createDataFrame([], rows.select(*MEMO).schema).withColumns({"complete": F.lit(True), "passed": F.lit(True)})
    tried, made, step = [], [], 0
    answered = None
    while True:
        step += 1
        todo = rows.where((F.col("step") == step) & F.col("problem").isNull())
        if answered is not None:
            todo = todo.join(answered, "request_id", "left_anti")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MEMO]
        memo = reduce(DataFrame.unionByName, [known, *made]).select(*[F.col(c).alias(f"_{c}") for c in MEMO], "complete", "passed")
        met = written(todo.join(memo, on, "left").drop(*[f"_{c}" for c in MEMO]), "round")
        if met.isEmpty():
            unwrite(met)
            break
        missing = met.where("complete is null").select(*MEMO).distinct()
        fresh = written(validate(missing).select(*MEMO, F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("passed", F.lit(False)).alias("passed")), "validated")
        renamed = fresh.select(*[F.col(c).alias(f"_{c}") for c in MEMO], F.col("complete").alias("_complete"), F.col("passed").alias("_passed"))
        done = met.join(renamed, on, "left").select("request_id", "candidate_id", "rank", F.lit(step).alias("round"), F.coalesce("complete", "_complete", F.lit(False)).alias("complete"), F.coalesce("passed", "_passed", F.lit(False)).alias("passed"), F.col("complete").isNotNull().alias("cached"))
        tried.append(written(done, "tried"))
        made.append(fresh)
        unwrite(met)
        won = reduce(DataFrame.unionByName, tried).where("complete and passed").select("request_id")
        answered = won.distinct()
    every = reduce(DataFrame.unionByName, tried, none)
    accepted = every.where("complete and passed").select("request_id", "candidate_id", "round", F.col("rank").alias("_last"))
    skipped = rows.where("problem is not null").join(accepted.select("request_id", "_last"), "request_id", "left").where(F.col("_last").isNull() | (F.col("rank") < F.col("_last")))
    outcome = F.when(F.col("complete") & F.col("passed"), "accepted").when(F.col("complete"), "needs_review").otherwise("incomplete")
    attempts = every.select("request_id", "candidate_id", "rank", "round", outcome.alias("outcome"), "cached").unionByName(skipped.select("request_id", "candidate_id", "rank", F.lit(None).cast("int").alias("round"), F.concat(F.lit("wrong document variant: "), F.col("problem")).alias("outcome"), F.lit(False).alias("cached")))
    return accepted.drop("_last"), attempts, reduce(DataFrame.unionByName, made, known.limit(0)).where("complete and passed")
