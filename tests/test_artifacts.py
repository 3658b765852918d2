"""Paged files, tables in text, and table artefacts with their commit protocol."""

import json
import os

import pytest
from pyspark.sql import functions as F

from paperweave.sources import artifacts, readers

TABLES = "document_id string, page_no long, table_index int, cells array<array<string>>"


def found(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_paged_files_with_page_filter_and_failed_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("first\fsecond é\f\ffourth\f", encoding="utf-8")
    (tmp_path / "two.txt").write_text("only", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9\fmore")
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "other.bin").write_bytes(b"x")
    rows = {(r["document_id"], r["page_no"]): (r["text"], r["status"], r["error"]) for r in readers.paged_files(spark, str(tmp_path)).collect()}
    assert rows == {
        ("a/one.txt", 1): ("first", "ok", None), ("a/one.txt", 2): ("second é", "ok", None), ("a/one.txt", 3): ("", "ok", None), ("a/one.txt", 4): ("fourth", "ok", None),
        ("two.txt", 1): ("only", "ok", None), ("bad.txt", None): (None, "failed", "not UTF-8"),
    }
    some = readers.paged_files(spark, str(tmp_path), [2, 4])
    assert sorted((r["document_id"], r["page_no"]) for r in some.where("status = 'ok'").collect()) == [("a/one.txt", 2), ("a/one.txt", 4)]
    assert some.where("status = 'failed'").count() == 1


def test_tables_in_text(spark):
    text = "intro\n| a | b |\n|1|2|\nno\nx | y\nalone no\n p|q \nr||s\n"
    got = readers.text_tables(spark.createDataFrame([("d", 1, text), ("d", 2, None), ("e", 1, "a|b")], "document_id string, page_no long, text string"))
    assert [(r["table_index"], r["cells"]) for r in got.orderBy("table_index").collect()] == [(1, [["a", "b"], ["1", "2"]]), (2, [["p", "q"], ["r", "", "s"]])]


def test_artifacts_are_written_whole_and_replace_earlier_ones(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("d/1", 1, 1, [["item", None], ['a "b", c', "1"]]), ("d/1", 2, 1, [["x"]]), ("e", 1, 1, [])]
    artifacts.table_artifacts(spark.createDataFrame(rows, TABLES).repartition(3), root)
    assert found(root) == ["d_1/page_1_table_1.csv", "d_1/page_1_table_1.json", "d_1/page_2_table_1.csv", "d_1/page_2_table_1.json", "e/page_1_table_1.csv", "e/page_1_table_1.json"]
    assert open(f"{root}/d_1/page_1_table_1.csv", newline="").read() == '"item",""\r\n"a ""b"", c","1"\r\n'
    side = json.load(open(f"{root}/d_1/page_1_table_1.json"))
    assert side["raw_rows"] == rows[0][3] and "contains_null_cells" in side["quality_flags"]
    artifacts.table_artifacts(spark.createDataFrame([("d/1", 1, 1, [["new"]])] * 2, TABLES), root)
    assert found(root) == ["d_1/page_1_table_1.csv", "d_1/page_1_table_1.json", "e/page_1_table_1.csv", "e/page_1_table_1.json"]
    assert open(f"{root}/d_1/page_1_table_1.csv").read() == '"new"\n'


def test_a_failed_task_leaves_no_artifact(spark, tmp_path):
    root = str(tmp_path / "out")
    artifacts.table_artifacts(spark.createDataFrame([("d", 1, 1, [["old"]])], TABLES), root)
    rows = [(f"d{i}", 1, 1, [["x"]]) for i in range(20)] + [("d", 1, 1, [["half"]]), ("...", 1, 1, [["no folder"]])]
    with pytest.raises(Exception, match="no folder"):
        artifacts.table_artifacts(spark.createDataFrame(rows, TABLES).repartition(4), root)
    assert found(root) == ["d/page_1_table_1.csv", "d/page_1_table_1.json"]
    assert open(f"{root}/d/page_1_table_1.csv").read() == '"old"\n'


def test_folders_stay_below_the_root():
    assert artifacts.folder_of("../../etc/passwd") == ".._.._etc_passwd"
    for bad in ("", None, "..", "./"):
        with pytest.raises(ValueError, match="no folder"):
            artifacts.folder_of(bad)


def test_artifacts_of_text(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "item | 2023\ncash | 10\ndebt | 20")], "document_id string, page_no long, text string")
    artifacts.table_artifacts(readers.text_tables(pages), str(tmp_path / "o"))
    assert json.load(open(tmp_path / "o/d/page_1_table_1.json"))["row_count"] == 3
    back = spark.read.option("multiLine", True).json(str(tmp_path / "o" / "*" / "*.json"))
    assert back.select(F.size("raw_rows")).first()[0] == 3
