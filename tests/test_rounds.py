"""Candidate rounds, resumed batches, clean-ups, plans in layers and continued reviews: stated cases."""

import os

import pytest
from pyspark.sql import functions as F

from paperweave.operators import batches, candidates, cleanup, packets
from paperweave.streaming import events, reviews

CANDIDATE = "request_id long, candidate_id long, rank int, problem string, document_id string, sha256 string, document_type string, symbol string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_candidates_are_tried_in_rounds_and_contents_validated_once(spark):
    c = [
        (1, 10, 1, None, "good", "h1", "annual_report", "s"), (1, 11, 2, None, "never", "h9", "annual_report", "s"),
        (2, 20, 1, "H-share announcement", "x", None, "annual_report", "s"), (2, 21, 2, None, "bad", "h2", "annual_report", "s"), (2, 22, 3, None, "good", "h1", "annual_report", "s"), (2, 23, 4, "H-share announcement", "x", None, "annual_report", "s"),
        (3, 30, 1, None, "bad", "h2", "annual_report", "s"), (3, 31, 2, None, "odd", "h3", "annual_report", None), (4, 40, 1, "H-share announcement", "x", None, "annual_report", "s"),
        (5, 50, 1, None, "kept", "h5", "annual_report", "s"), (5, 51, 1, None, "never", "h9", "annual_report", "s"), (6, 60, 1, None, "kept", "changed", "annual_report", "s"),
    ]
    asked = []

    def validate(missing):
        asked.extend((r["document_id"], r["sha256"]) for r in missing.collect())
        return missing.withColumns({"complete": F.col("document_id") != "bad", "passed": F.when(F.col("document_id") == "odd", F.lit(None).cast("boolean")).otherwise(F.col("document_id") != "bad")})

    kept = spark.createDataFrame([("kept", "h5", "annual_report", "s", True, True), ("bad", "h2", "annual_report", "s", False, True)], "document_id string, sha256 string, document_type string, symbol string, complete boolean, passed boolean")
    accepted, attempts, made = candidates.locate(spark.createDataFrame(c, CANDIDATE), validate, kept)
    assert rows(accepted) == [(1, 10, 1), (2, 22, 2), (5, 50, 1), (6, 60, 1)]
    assert sorted(asked) == [("bad", "h2"), ("good", "h1"), ("kept", "changed"), ("odd", "h3")]
    got = {(r["request_id"], r["candidate_id"]): (r["outcome"], r["cached"]) for r in attempts.collect()}
    assert got == {
        (1, 10): ("accepted", False), (2, 20): ("wrong document variant: H-share announcement", False), (2, 21): ("incomplete", False), (2, 22): ("accepted", True), (3, 30): ("incomplete", False), (3, 31): ("needs_review", False),
        (4, 40): ("wrong document variant: H-share announcement", False), (5, 50): ("accepted", True), (6, 60): ("accepted", False),
    }
    assert {r["document_id"] for r in made.collect()} == {"good", "kept"}


def test_no_candidates(spark):
    accepted, attempts, made = candidates.locate(spark.createDataFrame([], CANDIDATE), lambda m: m)
    assert accepted.count() == attempts.count() == made.count() == 0


def test_variants_and_addresses(spark):
    row = spark.range(1).select(
        candidates.wrong_variant(F.lit("hk"), F.lit("annual_report"), F.lit("Overseas  Regulatory Announcement")).alias("a"), candidates.wrong_variant(F.lit("A"), F.lit("annual_report"), F.lit("Overseas Regulatory Announcement")).alias("b"),
        candidates.wrong_variant(F.lit("A"), F.lit("annual_report"), F.lit("年报（H股公告）")).alias("c"), candidates.address(F.lit(""), F.lit("d")).alias("d"), candidates.tryable(F.lit("x.HTM"), F.lit("prospectus")).alias("e"), candidates.tryable(F.lit("x.htm"), F.lit("annual_report")).alias("f"),
    ).first()
    assert tuple(row) == ("overseas regulatory announcement", None, "H-share announcement", "d", True, False)


ITEMS = [(i, f"k{i % 7}", None if i % 5 == 0 else "x") for i in range(1, 41)]


def work(seen):
    def run(items):
        seen.extend(r["row_no"] for r in items.collect())
        return items.select("row_no", (F.col("row_no") != 4).alias("ok"), F.concat(F.lit("done "), F.col("key")).alias("status"))

    return run


def test_a_resumed_batch_equals_a_clean_run(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "row_no long, key string, more string")
    clean, seen, again = batches.Batch(items, ["key", "more"], str(tmp_path / "a"), strides=5), [], []
    clean.run(work(seen))
    assert len(seen) == len(set(seen)) == len({(k, m) for _, k, m in ITEMS})
    first = batches.Batch(items, ["key", "more"], str(tmp_path / "b"), strides=5)
    assert first.run(work(again), stop_on_error=True)["stopped"] and first.results().count() == 8
    other = batches.Batch(items.orderBy(F.desc("row_no")), ["key", "more"], str(tmp_path / "b"), strides=5)
    assert not other.run(work(again), resume=True)["stopped"]
    assert rows(other.results()) == rows(clean.results()) and sorted(again) == sorted(seen)
    assert other.results().where("deduplicated_from_row is not null").count() == 40 - len(seen)


def test_a_changed_batch_is_refused(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "row_no long, key string, more string")
    batches.Batch(items, ["key"], str(tmp_path), {"ocr": "off"}, 4).run(work([]), most_strides=1)
    for other, options, strides, resume, what in ((items.where("row_no < 40"), {"ocr": "off"}, 4, True, "input"), (items, {"ocr": "auto"}, 4, True, "options"), (items, {"ocr": "off"}, 3, True, "width"), (items, {"ocr": "off"}, 4, False, "begun before")):
        with pytest.raises(ValueError, match=what):
            batches.Batch(other, ["key"], str(tmp_path), options, strides).run(work([]), resume=resume)


def test_a_task_that_fails_leaves_the_batch_as_it_was(spark, tmp_path):
    items, calls = spark.createDataFrame(ITEMS, "row_no long, key string, more string"), []

    def broken(rows):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return work([])(rows)

    batch = batches.Batch(items, ["key"], str(tmp_path), strides=4)
    with pytest.raises(OSError, match="lost"):
        batch.run(broken)
    assert batch.results().count() == 10
    batch.run(broken, resume=True)
    assert batch.results().count() == 40 and len(calls) == 5


def test_clean_up_plans_are_made_before_anything_is_deleted(spark, tmp_path):
    root = str(tmp_path / "data")
    for f in ("raw/a.pdf", "raw/shared.pdf", "raw/both.pdf", "raw/loose.pdf", "parsed/d1/pages.jsonl", "parsed/old/x"):
        os.makedirs(os.path.dirname(f"{root}/{f}"), exist_ok=True)
        open(f"{root}/{f}", "w").close()
    documents = spark.createDataFrame([("d1", f"{root}/raw/a.pdf", f"{root}/parsed/d1"), ("d2", f"{root}/raw/shared.pdf", "/etc/d2"), ("d3", f"{root}//raw/SHARED.pdf", None), ("d4", f"{root}/raw/both.pdf", None), ("d5", f"{root}/raw/both.pdf", f"{root}/../d5")], "document_id string, file_path string, parsed_path string")
    there = spark.createDataFrame([(f"{root}/{f}",) for f in ("raw/a.pdf", "raw/shared.pdf", "raw/both.pdf", "raw/loose.pdf", "parsed/d1", "parsed/old")], "path string")
    gone = spark.createDataFrame([("d1",), ("d2",), ("d4",), ("d5",), ("d9",)], "document_id string")
    steps = cleanup.plan(gone, documents, documents.limit(0), there, root).cache()
    got = {(r["document_id"], r["kind"]): (r["action"], r["reason"]) for r in steps.collect()}
    assert got == {
        ("d1", "records"): ("delete", None), ("d1", "file"): ("delete", None), ("d1", "parsed"): ("delete", None), ("d2", "records"): ("delete", None), ("d2", "file"): ("keep", "referenced by others"), ("d2", "parsed"): ("keep", "outside the data folder"),
        ("d4", "records"): ("delete", None), ("d4", "file"): ("delete", None), ("d5", "records"): ("delete", None), ("d5", "file"): ("delete", None), ("d5", "parsed"): ("keep", "outside the data folder"), ("d9", "records"): ("keep", "no record"),
    }
    assert os.path.exists(f"{root}/raw/a.pdf")
    assert {r["deleted"] for r in cleanup.execute(steps).collect()} == {True}
    assert sorted(os.listdir(f"{root}/raw")) == ["loose.pdf", "shared.pdf"] and os.listdir(f"{root}/parsed") == ["old"]
    assert {r["deleted"] for r in cleanup.execute(steps).collect()} == {False}
    assert rows(cleanup.remaining(documents, steps).select("document_id")) == [("d3",)]
    parsed = spark.createDataFrame([("old", f"{root}/parsed/old", False), ("d3", f"{root}/parsed/d3", True)], "document_id string, path string, has_pages boolean")
    found = cleanup.reconcile(cleanup.remaining(documents, steps), there.where("path like '%shared%' or path like '%loose%'"), parsed, root)
    assert rows(found.select("document_id", "kind", "action", "reason")) == [("old", "parsed", "delete", "no document"), (None, "file", "report", "no document")]


def test_plans_show_pages_by_queries_and_turns_and_cycles_show_nothing(spark):
    pages = spark.createDataFrame([("a", 1, "red blue"), ("a", 2, "red"), ("a", 3, "red green"), ("b", 1, "red"), ("c", 1, "blue " * 30)], "document_id string, page_no long, text string")
    claims = spark.createDataFrame([
        (1, "x", 1, ["y"], ["red", "blue"], None), (1, "y", 2, [], ["red"], ["b", " a ", "zz"]), (2, "p", 1, ["q"], ["red"], None), (2, "q", 2, ["p"], ["red"], None), (2, "r", 3, [], ["red"], None),
    ], "plan_id long, claim_id string, claim_no int, depends_on array<string>, queries array<string>, document_ids array<string>")
    out, bad = packets.execute_plans(claims, pages, 3, 100, 1000)
    assert [(r["document_id"], r["page_no"]) for r in out.where("claim_id = 'x'").orderBy("place").collect()] == [("a", 1), ("a", 2), ("a", 3)]
    assert [(r["document_id"], r["page_no"]) for r in out.where("claim_id = 'y'").orderBy("place").collect()] == [("b", 1), ("a", 1), ("a", 2)]
    assert rows(bad) == [(2, "p", "dependency cycle"), (2, "q", "dependency cycle")] and out.where("plan_id = 2").count() == 0
    # The claim that others wait for is given its characters first: all of 12 // 2, which leaves the rest to the other.
    few, _ = packets.execute_plans(claims.where("plan_id = 1"), pages, 3, 100, 12)
    assert {r["claim_id"]: r["n"] for r in few.groupBy("claim_id").agg(F.sum(F.length("text")).alias("n")).collect()} == {"y": 6, "x": 6}


REVIEW = "plan_id string, review_id string, fingerprint string, pos long, problem string, open_claims array<string>, most_rounds int"


def test_reviews_over_many_batches_and_a_replayed_one(spark, tmp_path):
    first = [("p", "r1", "f", 1, None, ["b", "a"], 2), ("p", "r2", "other", 2, None, [], 2), ("q", "r1", "g", 1, "bad", ["a"], None), ("s", "r1", "h", 1, None, None, None)]
    later = [first[0], ("p", "r3", "f", 3, None, ["a"], 2), ("p", "r4", "f", 4, None, [], 2), ("q", "r2", "g", 2, None, ["a"], None)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in (first, later, later):
        spark.createDataFrame(batch, REVIEW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(source)
        events.run_once(reviews.continued(stream), out, check).awaitTermination()
    got = {(r["plan_id"], r["review_id"]): (r["round"], r["stage"], r["follow_ups"]) for r in spark.read.schema(reviews.OUTPUT).parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got) == 7
    assert got == {
        ("p", "r1"): (2, "follow_up", ["a", "b"]), ("p", "r2"): (2, "invalid_analysis_context", []), ("p", "r3"): (2, "rounds_used", []), ("p", "r4"): (2, "closed", []),
        ("q", "r1"): (1, "invalid_review", []), ("q", "r2"): (2, "follow_up", ["a"]), ("s", "r1"): (1, "complete", []),
    }


def test_fingerprints(spark):
    f = spark.range(1).select(reviews.fingerprint(F.lit("a  b"), F.lit(1)).alias("x"), reviews.fingerprint(F.lit(" a b"), F.lit(1)).alias("y"), reviews.fingerprint(F.lit("a"), F.lit("b1")).alias("z"), reviews.fingerprint(F.lit("ab"), F.lit("1")).alias("w")).first()
    assert f["x"] == f["y"] and len({f["x"], f["z"], f["w"]}) == 3


def test_cycles_are_found_without_a_search(spark, monkeypatch):
    from paperweave.plans import queries_rounds

    monkeypatch.setattr(queries_rounds, "kept_turns", lambda *_: pytest.fail("an index was made"))
    assert queries_rounds.plan_cycles(spark, "/root/testdata/sf0.001").count() > 0


def test_a_review_without_a_claim_is_unexpected_and_not_lost(spark):
    reviews = spark.createDataFrame([("p", None, "sufficient", ["e1"]), ("p", "b", "Partial", ["e1"]), ("p", "b", "sufficient", ["e2"])], "plan_id string, claim_id string, status string, evidence_ids array<string>")
    registry = spark.createDataFrame([("p", "a", ["e1"]), ("p", "b", ["e1"]), ("q", "a", ["e1"])], "plan_id string, claim_id string, evidence_ids array<string>")
    found = {(r["plan_id"], r["claim_id"], r["problem"]) for r in packets.review_problems(reviews, registry).collect()}
    assert found == {("p", None, "unexpected claim"), ("p", "a", "missing claim"), ("p", "b", "repeated claim"), ("p", "b", "unknown evidence")}
