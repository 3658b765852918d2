"""Stated cases with known answers."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperweave.functions import exact, quality, text
from paperweave.operators import documents, evidence, lifecycle, search
from paperweave.plans import calculations, review
from paperweave.sources import readers, writers

PAGES = "document_id string, page_no long, text string"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def hits(spark, pages, query, hybrid=False):
    df = spark.createDataFrame([("d", n, t) for n, t in pages.items()], PAGES)
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    found = search.phrase_filter(search.hybrid_hits(df, [("q", query)], asked).select("query_id", "document_id", "page_no", "branch", "score"), df, asked)
    return [r["page_no"] for r in found.orderBy("branch", F.desc("score"), "page_no").collect()]


def test_phrase_filter_keeps_pages_with_the_phrase(spark):
    assert hits(spark, {1: "The incentives are deducted from revenues.", 2: "Costs are deducted from its revenues."}, "deducted from revenues") == [1]


def test_phrase_filter_falls_back_to_all(spark):
    assert hits(spark, {1: "The cost details of wages and other items affected revenues."}, "cost of revenues") == [1]


def test_substring_of_a_cjk_run(spark):
    assert hits(spark, {56: "营业收入是公司关键业绩指标，可能存在不恰当的收入确认风险。"}, "收入确认") == [56]
    assert hits(spark, {9: "王亚歌先生为公司首席财务官。", 39: "王亚歌，毕业于中国财政科学研究院，…"}, "王亚歌") == [9, 39]


def test_page_with_more_terms_comes_first(spark):
    full = "platform income fee delivery merchant commission order service user growth"
    assert hits(spark, {10: full, 12: "delivery merchant only"}, full) == [10, 12]


def test_accents_and_ids_count_as_words(spark):
    df = spark.createDataFrame([("600519-annual", 1, "Café au lait")], PAGES)
    for query, n in (("cafe", 1), ("600519 cafe", 1), ("tea", 0)):
        assert search.word_hits(df, spark.createDataFrame([("q", query)], "query_id string, query string")).count() == n


def test_text_quality(spark):
    m = lambda t: one(spark, quality.metrics(F.col("t")), t=t)
    assert m("A;B>C?D\x01" * 80 + "\n")["garbled"]
    layout = m("Revenue \x02 subscriptions and services \x02 " * 20)
    assert layout["control_ratio"] >= 0.02 and layout["readable"] and not layout["garbled"]
    assert m(None)["control_count"] == 0


@pytest.mark.parametrize(("query", "route"), [
    ("下载2024年年报", "filing_search_download_ingest"), ("贵州茅台资产负债表", "structured_financials"), ("公司资料", "structured_profile"), ("分红情况", "structured_company_data"),
    ("招股书下载", "prospectus_search_download_ingest"), ("收入确认政策", "local_document_evidence"), ("港股2024年新上市公司名单", "unsupported_hk_ipo_annual_list"), ("hello", "hybrid_structured_and_filing_evidence"),
])
def test_routes(spark, query, route):
    assert one(spark, text.route(F.col("q")), q=query) == route


def test_names(spark):
    assert one(spark, text.safe_name(F.col("t")), t=' a/b:c  d"e. ') == "a_b_c_d_e"
    assert one(spark, text.safe_slug(F.col("t")), t="Annual Report (2024)") == "annual_report_2024"
    assert one(spark, text.safe_name(F.col("t")), t=None) == "document"
    assert one(spark, text.report_year(F.col("t"), F.lit("2023-04-01")), t="report") == "2023"
    assert one(spark, text.h_symbol(F.col("t")), t="700.HK") == "00700"
    assert one(spark, text.date_of_url(F.col("t")), t="/2018/0907/ltn20180907017.pdf") == "2018-09-07"
    assert one(spark, text.sequence_of_url(F.col("t")), t="/2018/0907/ltn20180907017.pdf") == "ltn20180907017"
    assert one(spark, text.chinese_twin_url(F.col("t")), t="https://x/2026042300752.pdf") == "https://x/2026042300753_c.pdf"
    assert one(spark, text.file_size_of_label(F.col("t")), t="1.5MB") == 1572864


def identity(spark, body, **want):
    values = {"expected_year": None, "expected_company": None, "expected_symbol": None} | want
    df = spark.createDataFrame([(body, *values.values())], "text string, expected_year int, expected_company string, expected_symbol string")
    return documents.identity(df).first()


def test_identity(spark):
    assert identity(spark, "POP MART INTERNATIONAL Stock Code: 9992 Annual Report 2025", expected_year=2025, expected_symbol="09992")["passed"]
    other = identity(spark, "Annual Report 2025, page 5, unrelated issuer", expected_year=2025, expected_symbol="00005")
    assert other["symbol_match"] is False and not other["passed"]


def test_completeness(spark):
    body = ["獨立核數師報告", "綜合財務狀況表", "合併利潤表", "財務報表附註"]
    df = spark.createDataFrame([("a", i + 1, body[i] if i < 4 else "x" * 200) for i in range(188)] + [("b", 1, "cover"), ("b", 2, "end")], PAGES)
    found = {r["document_id"]: (r["status"], r["complete"]) for r in documents.completeness(df).collect()}
    assert found == {"a": ("complete", True), "b": ("rejected_short_document", False)}


def test_table_structure():
    rows = [["项目", "2024年度", None, "2023年度", None], [None, "境内", "境外", "境内", "境外"], [None, "收入", "收入", "收入", "收入"], ["产品甲", "100", "20", "90", "10"], ["产品乙", "50", "5", "40", "4"]]
    depth, _, paths, *_ = documents.table_structure(rows)
    assert depth == 3 and paths[0] == ["项目"] and paths[1] == ["2024年度", "境内", "收入"]
    people = documents.table_structure([["Alice", "Paris"], ["Bob", "Rome"], ["Carol", "Oslo"]])
    assert people[0] == 0 and "header_low_confidence" in people[5]
    assert documents.table_structure([])[5] == ["empty_table"]


def test_expressions():
    ev = lambda e, **v: exact.plain(exact.evaluate(e, {k: Decimal(x) for k, x in v.items()}))
    assert ev("(a - b) / b * 100", a="121", b="100") == "21"
    assert ev("round(2.5) + round(1.005, 2) + abs(-1) + min(3, 2) ** 2") == "8"
    assert ev("1 / 3") == "0." + "3" * 38
    for bad in ("__import__('os')", "a", "1 / 0", "2 ** 99", "x.y", "", "a" * 501, "2 ** 0.5"):
        with pytest.raises(ValueError):
            exact.evaluate(bad, {})


def tokens(spark, body):
    return [(plain(t["value"]), t["percent"]) for t in one(spark, exact.number_tokens(F.col("t")), t=body)]


def plain(x):
    return exact.plain(x)


def test_number_tokens(spark):
    assert tokens(spark, "The value is 1234.") == [("1234", False)]
    assert tokens(spark, "Loss for the year was (1,234).") == [("-1234", False)]
    assert tokens(spark, "The rate was 12.5%, up from −3 %") == [("12.5", True), ("-3", True)]
    assert tokens(spark, "v1.2 a123 (12") == []
    plainly = [m[0] for m in re.finditer(exact.NUMBER, "1,234.5 and .5 or 12,34 x 7")]
    assert len(plainly) == len(tokens(spark, "1,234.5 and .5 or 12,34 x 7"))


def verify(spark, sets, texts, depth=30):
    rows = []
    for s, (name, expression, expected, tolerance, checks, variables) in sets:
        full = [dict.fromkeys(("name", "value", "scale", "unit", "period", "scope", "currency", "evidence_id", "source_type", "calculation_id", "source_format", "relation")) | v for v in variables]
        rows.append((s, name, expression, expected, tolerance, None, None, checks, full))
    calc = spark.createDataFrame(rows, f"set_id string, calculation_id string, expression string, expected string, absolute_tolerance string, relative_tolerance string, expected_precision int, checks array<string>, variables array<{calculations.VARIABLE}>")
    cited = spark.createDataFrame(list(texts.items()), "evidence_id string, text string")
    return {(r["set_id"], r["calculation_id"]): r for r in calculations.verify(calc, cited, depth).collect()}


def test_verify_calculations(spark):
    v = lambda name, value, eid=None, **more: {"name": name, "value": value, "evidence_id": eid} | more
    texts = {"e1": "The value is 1234.", "e2": "Loss for the year was (1,234).", "e3": "The rate was 12.5%.", "e4": "The parent held 75%.", "e5": "Reported value was 80."}
    sets = [
        ("a", ("c", "x", None, None, [], [v("x", "123", "e1")])),
        ("b", ("c", "x", "-1234", None, [], [v("x", "-1234", "e2")])),
        ("c", ("c", "p + r + m", "12.875", None, [], [v("p", "12.5", "e3", source_format="percent"), v("r", "0.125", "e3", source_format="ratio"), v("m", "0.25", "e4", source_format="ratio", relation="complement")])),
        ("d", ("c", "1.234 * x", "1.23", None, [], [v("x", "1", source_type="assumption")])),
        ("e", ("c", "10.4 * x", "10", None, [], [v("x", "1", source_type="assumption")])),
        ("f", ("c", "1.234 * x", "1.23", "0", [], [v("x", "1", source_type="assumption")])),
        ("g", ("c", "x", "90", None, [], [v("x", "100", "e5")])),
        ("h", ("c", "x + y", None, None, ["same_unit"], [v("x", "1", source_type="assumption", unit="m"), v("y", "2", source_type="assumption", unit="k")])),
    ]
    found = {k[0]: (r["status"], r["arithmetic_status"]) for k, r in verify(spark, sets, texts).items()}
    assert found["a"] == ("unlinked", "calculated")
    assert found["b"] == found["c"] == ("verified", "verified")
    assert found["d"][0] == "verified" and found["e"][0] == "discrepancy" and found["f"][0] == "discrepancy"
    assert found["g"] == ("unlinked", "discrepancy")
    assert found["h"][0] == "context_mismatch"


def test_results_feed_later_calculations_of_their_own_set(spark):
    v = lambda **x: {"name": "x"} | x
    sets = [(s, ("one", "x", None, None, [], [v(value=str(i), source_type="assumption")])) for i, s in enumerate("ab", 1)]
    sets += [(s, ("two", "x * 10", str(10 * i), None, [], [v(source_type="calculation", calculation_id="one")])) for i, s in enumerate("ab", 1)]
    sets += [("a", ("lost", "x", None, None, [], [v(source_type="calculation", calculation_id="none")])), ("a", ("me", "x", None, None, [], [v(source_type="calculation", calculation_id="me")]))]
    found = verify(spark, sets, {"e": ""}, depth=2)
    assert [found[s, "two"]["calculated"] for s in "ab"] == ["10", "20"] and found["a", "two"]["status"] == "verified"
    assert found["a", "lost"]["status"] == "invalid" == found["a", "me"]["status"]


def test_a_chain_of_calculations_takes_no_tables_by_layer(spark, monkeypatch):
    made, written = [], calculations.written
    monkeypatch.setattr(calculations, "written", lambda df, name: made.append(name) or written(df, name))
    first = ("c0", "x", None, None, [], [{"name": "x", "value": "1", "source_type": "assumption"}])
    chain = [(f"c{i}", "x + 1", str(i + 1), None, [], [{"name": "x", "source_type": "calculation", "calculation_id": f"c{i - 1}"}]) for i in range(1, 8)]
    found = verify(spark, [(s, c) for s in "ab" for c in [first, *chain]], {})
    assert {found[s, f"c{i}"]["calculated"] for s in "ab" for i in range(1, 8)} == set("2345678") and len(made) <= 2
    assert found["b", "c7"]["status"] == "verified" and len(found) == 16


def test_a_calculation_without_a_set_is_invalid_and_not_lost(spark):
    v = {"name": "x", "value": "1", "source_type": "assumption"}
    found = verify(spark, [(None, ("c", "x", None, None, [], [v])), ("a", ("c", "x", None, None, [], [v]))], {})
    assert found[None, "c"]["status"] == "invalid" and found["a", "c"]["status"] == "calculated"


def test_conflicts(spark):
    facts = [("c", "revenue", "2025", "rmb", "group", "123456", "e1"), ("c", "Revenue", "2025", "RMB", "group", "123455", "e2"), ("d", "revenue", "2025", "rmb", "group", "1", "e1"), ("d", "revenue", "2024", "rmb", "group", "2", "e2")]
    df = spark.createDataFrame(facts, "claim_id string, fact_key string, period string, unit string, scope string, value string, evidence_id string")
    assert [r["claim_id"] for r in review.conflicts(df, ["claim_id", "fact_key", "period", "unit", "scope"]).collect()] == ["c"]


def test_layers():
    assert review.layer_of([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("z", ["y"])]) == {"a": 0, "b": 1, "c": 2, "x": -1, "y": -1, "z": -1}
    with pytest.raises(ValueError):
        review.normalise_plan({"claims": [{"claim_id": "a", "question": "q", "search_queries": ["s"], "depends_on_claim_ids": ["b"]}]})
    assert review.normalise_plan({"claims": [{"question": "q", "search_queries": ["s ", "s"]}]})["claims"][0]["search_queries"] == ["s"]


def test_exact_user_query_is_among_the_chosen(spark):
    merged = spark.createDataFrame([("g", "d", n, [q], [t], [""], False) for n, q, t in ((5, "gross margin", "mda"), (20, "my words", "user_query"), (30, "year ended", "segment_note"))], "query_group string, document_id string, page_no long, matched_queries array<string>, evidence_types array<string>, snippets array<string>, is_adjacent boolean")
    chosen = evidence.select_diverse(merged, 2).orderBy("place").collect()
    assert [r["page_no"] for r in chosen] == [20, 5]


def test_best_type(spark):
    assert one(spark, evidence.best_type(F.array(F.lit("adjacent"), F.lit("mda"))), a="") == "mda"
    assert one(spark, evidence.best_type(F.array().cast("array<string>")), a="") == "page"


def test_batch_runs_equal_items_once(spark):
    items = spark.createDataFrame([(1, "A", "600519"), (2, "A", "600519"), (3, None, "1"), (4, "", "1")], "row int, market string, symbol string")
    plan = {r["row"]: r["deduplicated_from_row"] for r in lifecycle.batch_plan(items, ["market", "symbol"], "row").collect()}
    assert plan == {1: None, 2: 1, 3: None, 4: 3}


def test_disposition(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, False), (True, False, True), (False, True, True), (None, True, True)], "c boolean, p boolean, t boolean")
    assert [r[0] for r in df.select(documents.disposition(F.col("c"), F.col("p"), F.col("t"))).collect()] == ["accepted", "needs_review", "accepted", "deleted", "needs_review"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"page_no": 1, "text": "one"}\n\n{"text": "none"}\n')
    pages = readers.pages_jsonl(spark, str(tmp_path / "p.jsonl"), "d")
    assert sorted((r["page_no"], r["char_count"]) for r in pages.collect()) == [(0, 4), (1, 3)]
    assert readers.jsonl(spark, str(tmp_path / "missing.jsonl"), "a int").count() == 0
    (tmp_path / "b.json").write_text('{"items": [{"market": "A", "symbol": "1"}]}')
    (tmp_path / "b.csv").write_text("﻿market,symbol\nA,1\n")
    for name in ("b.json", "b.csv"):
        assert readers.batch_items(spark, str(tmp_path / name)).count() == 1
    with pytest.raises(ValueError):
        readers.batch_items(spark, "b.txt")
    assert writers.full_text(pages).first()["full_text"] == "none\n\none"
    new = spark.createDataFrame([("d", 0, "no"), ("d", 2, "two")], PAGES)
    old = spark.createDataFrame([("d", 1, "x"), ("e", 1, "y")], PAGES)
    assert sorted((r["document_id"], r["page_no"]) for r in writers.replace_pages(old, new).collect()) == [("d", 2), ("e", 1)]
    assert [x["href"] for x in one(spark, readers.links(F.col("h")), h='<a href="/a.pdf" class=x>A <b>b</b></a><A HREF=\'/c\'>c</A>')] == ["/a.pdf", "/c"]


def test_stream_keeps_each_id_once_over_many_batches(spark, tmp_path):
    import os

    from paperweave.streaming import events as streaming

    batches = [[(1, "2024-03-01"), (2, "2024-03-02")], [(3, "2024-01-01"), (1, "2024-02-01")], [(4, "2024-06-01")], [(1, "2024-07-01"), (5, "2023-01-01"), (3, "2024-07-02")], [(2, "2024-07-03"), (6, "2024-03-01")]]
    (tmp_path / "events.parquet").mkdir()
    for i, rows in enumerate(batches):
        name = tmp_path / "events.parquet" / f"{i}.parquet"
        spark.createDataFrame(rows, "event_id long, ts string").toPandas().to_parquet(name)
        os.utime(name, (1700000000 + i, 1700000000 + i))
    stream = streaming.once_each(streaming.read_events(spark, str(tmp_path), files_per_trigger=1))
    done = streaming.run_once(stream, str(tmp_path / "rows"), str(tmp_path / "state"))
    done.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in done.recentProgress) == len(batches)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [1, 2, 3, 4, 5, 6]


def test_duplicates_need_no_stored_size(spark):
    rows = [(1, "same", 4), (2, "same", None), (3, "same", 4), (4, "once", 4), (5, "two", None), (6, "two", None), (7, None, None), (8, None, 0), (9, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = lifecycle.duplicates(docs, "text", F.md5("text"), "doc_id", "n_chars").collect()
    assert sorted((r["members"], r["n"], r["n_chars"]) for r in found) == [([1, 2, 3], 3, 4), ([5, 6], 2, None), ([7, 8], 2, 0)]
    each = lifecycle.duplicate_rows(docs, "text", F.md5("text"), "doc_id").collect()
    assert sorted((r["doc_id"], r["n"], r["first"]) for r in each) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (5, 2, 5), (6, 2, 5), (7, 2, 7), (8, 2, 7)]


def test_duplicate_query_with_null_sizes(spark, tmp_path):
    from paperweave.plans import queries_keyed

    rows = [(1, "same", 4), (2, "same", None), (3, "two", None), (4, "two", None), (5, None, None), (6, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries_keyed.duplicate_groups_size_then_hash(spark, str(tmp_path)).collect()
    assert sorted(r["members"] for r in found) == ["1,2", "3,4", "5,6"]


def test_packet_shows_a_match_late_in_its_page(spark, tmp_path):
    from paperweave.plans import queries_search

    late = "x" * 40 + " " + "filler " * 200 + "the thing is here " + "more " * 100
    rows = [(7, turn, "user", late) for turn in (0, 2, 4)] + [(8, 0, "user", "short text of it")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries_search.excerpt_packet(spark, str(tmp_path)).collect()
    assert sorted((r["document_id"], r["page_no"]) for r in found) == [("7", 1), ("7", 3), ("7", 5), ("8", 1)]
    long = sorted((r for r in found if r["document_id"] == "7"), key=lambda r: r["place"])
    assert all("the thing" in r["text"] and r["text"].startswith("...") for r in long)
    assert [len(r["text"]) for r in long] == [506, 506, 194] and [r["truncated"] for r in long] == [False, False, True]


@pytest.mark.parametrize("terms", [["late words"], ["none", "deeper meaning"], ["nothing"], ["  Late WORDS "], ["", "zz deep"]])
def test_excerpts_by_row_and_by_stated_terms_agree(spark, terms):
    body = "head " * 30 + "late words " + "tail " * 30 + "deeper " + "end " * 30
    df = spark.createDataFrame([(body, terms), ("short", terms), (None, terms)], "text string, queries array<string>")
    both = df.select(evidence.around_matches(F.col("text"), F.col("queries"), F.lit(60)).alias("a"), search.excerpt(F.col("text"), terms, 60).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_of_several_linked_rows_the_last_counts(spark):
    cached = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    linked = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "", 1)], "id int, v string, at int")
    assert sorted(map(tuple, lifecycle.override(cached, linked, "id", ["v"], ["at"]).collect())) == [(1, "y"), (2, "b")]


def test_limited_says_whether_there_was_more(spark):
    for most, more in ((2, True), (3, False), (4, False)):
        rows, info = readers.limited(spark.range(3), most, [F.col("id")])
        assert info == {"returned_rows": min(most, 3), "truncated": more} and rows.count() == min(most, 3)


def test_query_language():
    assert search.parse('a b* "c d" NOT e OR f') == [{"all": [("word", "a"), ("prefix", "b"), ("phrase", "c d")], "none": [("word", "e")]}, {"all": [("word", "f")], "none": []}]
    assert all(search.parse(x) is None for x in ("", "p&l", "revenue?", '"open', "OR a", "a NOT", "a OR"))


def test_bad_calculation_sets_hinder_no_other(spark):
    v = lambda name: {"name": name, "value": "1", "source_type": "assumption"}
    sets = [("a", ("c", "x", None, None, [], [v("x"), v("x")])), ("b", ("c", "x", None, None, [], [v("x")])), ("b", ("c", "x", None, None, [], [v("x")])), ("c", (None, "x", None, None, [], [v("x")])), ("d", ("c", "x", None, None, [], [v("x")])), ("e", ("c", "x", None, None, [], [v(None)]))]
    found = {k: r["status"] for k, r in verify(spark, sets, {"e": ""}).items()}
    assert found["d", "c"] == "calculated" and {s for k, s in found.items() if k[0] != "d"} == {"invalid"}


def test_planned_packet(spark):
    from paperweave.operators import packets

    filler = "words of no use in any question, " * 10
    pages = spark.createDataFrame([("d", 1, "cover"), ("d", 2, filler), ("d", 3, "revenue recognition is set out here"), ("d", 4, filler), ("d", 6, "user incentives, deducted from revenues")], PAGES)
    asked = spark.createDataFrame([("q", "coupons", "accounting_policy")], "question_id string, question string, strategy string")
    found = {r["page_no"]: r["matched_queries"] for r in packets.planned(asked, pages).collect()}
    assert set(found) == {2, 3, 4, 6} and "deducted from revenues" in found[6] and "revenue recognition" in found[3]
    assert packets.planned(asked, pages, most_pages=0).count() == 0


def test_expansion_moves_and_sorts_nothing(spark):
    from paperweave.operators import packets

    rows = [("a", "Revenue  Recognition", "accounting_policy"), ("b", "  ", "basic"), ("c", None, "accounting_policy"), ("d", "user incentives", "financial_analysis")]
    out = packets.expand(spark.createDataFrame(rows, "question_id string, question string, strategy string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    found = {}
    for r in out.collect():
        found.setdefault(r["question_id"], []).append((r["pos"], r["query"]))
    assert found["a"][:2] == [(0, "Revenue Recognition"), (2, "收入确认")] and "b" not in found and found["c"][0] == (1, "revenue recognition")
    assert all(len({q.lower() for _, q in qs}) == len(qs) for qs in found.values())


def test_a_cell_of_a_table_is_tested_once(monkeypatch):
    from paperweave.operators import documents

    asked = []
    monkeypatch.setattr(documents, "_cell", lambda t: asked.append(t) or (t.isdigit(), not t.isdigit()))
    documents.table_structure([["item", "total"], *[[str(i), str(100 + i)] for i in range(50)]])
    assert len(asked) == len(set(asked)) == 16
