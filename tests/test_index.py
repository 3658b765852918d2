"""The kept index: same results as a scan, updates, phrases, bounds, and its stated cases."""

import gc
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperweave.operators import index, search
from paperweave.session import settings
from paperweave.sources import manifests


def some_pages(seed=1, docs=30, size=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "Émile", "an_id", "中文字符"]
    return [(f"d{d}", p, " ".join(r.choices(words, k=r.randint(0, size)))) for d in range(docs) for p in range(1, r.randint(2, 6))]


SCHEMA = "document_id string, page_no long, text string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([*some_pages(), ("e1", 1, None), ("e2", 1, ""), ("e3", 1, "the of the of the")], SCHEMA).cache()


@pytest.fixture(scope="module")
def kept(spark, pages, tmp_path_factory):
    return index.update(spark, str(tmp_path_factory.mktemp("index")), pages, buckets=4, blocks=8, files=2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


QUERIES = [("a", "w1 w2"), ("b", "the of"), ("c", "emile"), ("d", "w1 nothere"), ("e", "..."), ("f", "d3 w4"), ("g", "w5"), (None, "w6 w6")]


def test_words_as_by_a_scan_and_from_the_rarest_token(spark, pages, kept, monkeypatch):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    texts = [(d, p, {t for t in (r or [])}) for d, p, r in pages.select("document_id", "page_no", search.tokens(F.concat_ws(" ", "document_id", "text"))).collect()]
    want = sorted(((q, d, p) for q, ts in asked.select("query_id", search.tokens(F.col("query"))).collect() if ts for d, p, has in texts if set(ts) <= has), key=str)
    want = [w for w in want if w[0] is not None]
    assert rows(index.word_hits(kept, asked.where("query_id is not null"))) == want
    assert rows(search.word_hits(pages, asked.where("query_id is not null"))) == want
    monkeypatch.setattr(index, "MOST_STATED", 2)
    assert rows(index.word_hits(kept, asked.where("query_id is not null"))) == want
    assert rows(search.word_hits(pages, asked.where("query_id is not null"))) == want


def test_pages_of_many_distinct_words(spark):
    """What a row carries does not grow with the page: four pages of 16,000 distinct words."""
    wide = spark.range(4).select(F.col("id").cast("string").alias("document_id"), F.lit(1).alias("page_no"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15_999)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"))
    asked = spark.createDataFrame([("a", "word15 word15999"), ("b", "word16000")], "query_id string, query string")
    assert rows(search.word_hits(wide, asked)) == [("a", str(i), 1) for i in range(4)]


GRAMMAR = [("g1", "w1 w2*"), ("g2", "w1 OR emile"), ("g3", "the NOT of"), ("g4", '"the of the"'), ("g5", "an_id"), ("g6", '"w1 w2" OR "w3 w4"'), ("g7", "w1 NOT w2* NOT the"), ("g8", "w999*"), ("g9", "(")]


def test_query_language_by_positions(spark, pages, kept):
    found, plain = index.grammar_hits(kept, GRAMMAR)
    texts = [(d, p, " " + " ".join(t or []) + " ") for d, p, t in pages.select("document_id", "page_no", search.tokens(F.concat_ws(" ", "document_id", "text"))).collect()]
    begins = lambda t, w: f" {w}" in t
    has = lambda t, w: f" {w} " in t
    tests = {
        "g1": lambda t: has(t, "w1") and begins(t, "w2"), "g2": lambda t: has(t, "w1") or has(t, "emile"), "g3": lambda t: has(t, "the") and not has(t, "of"), "g4": lambda t: has(t, "the of the"),
        "g5": lambda t: has(t, "an id"), "g6": lambda t: has(t, "w1 w2") or has(t, "w3 w4"), "g7": lambda t: has(t, "w1") and not begins(t, "w2") and not has(t, "the"),
    }
    assert rows(found) == sorted(((q, d, p) for q, f in tests.items() for d, p, t in texts if f(t)), key=str)
    assert plain == [("g9", "(")]


@pytest.mark.parametrize("relaxed", [False, True])
def test_substrings_as_by_a_scan(spark, pages, kept, relaxed):
    asked = [("s1", "w1 w2"), ("s2", "文字符"), ("s3", "no such words"), ("s4", "W5"), ("s5", "the of"), ("s6", "qq zz"), ("s7", "")]
    asked = [a for a in asked if a[1]]
    assert rows(index.substring_hits(kept, asked, relaxed)) == rows(search.substring_hits(pages, asked, relaxed))


def test_terms_of_one_or_two_letters_are_found(kept, pages):
    low = F.lower(F.coalesce("text", F.lit("")))
    assert rows(index.term_hits(kept, [("x", "中"), ("y", "W1")]).drop("text")) == rows(pages.where(low.contains("中")).select(F.lit("x"), "document_id", "page_no").union(pages.where(low.contains("w1")).select(F.lit("y"), "document_id", "page_no")))


def test_bm25_with_bounds_reads_fewer_postings_and_ranks_the_same(spark, tmp_path):
    r = random.Random(5)
    rows_ = [(f"d{d}", 1, " ".join(["common"] * r.randint(0, 3) + r.choices([f"w{i}" for i in range(200)], k=30) + (["rare"] * r.randint(1, 9) if r.random() < 0.06 else []))) for d in range(600)]
    pages = spark.createDataFrame(rows_, SCHEMA)
    kept = index.update(spark, str(tmp_path / "i"), pages, buckets=4, blocks=64)
    asked = spark.createDataFrame([("a", "rare common w7"), ("b", "rare"), ("c", "w1 w2 w3 w4"), ("d", "none")], "query_id string, query string")
    plain = search.top(search.bm25(pages, asked), 5, [F.desc("score"), F.col("document_id"), F.col("page_no")])
    assert rows(index.bm25(kept, asked, 5)) == rows(plain.select("query_id", "document_id", "page_no", "score", "rank"))
    ranking = index.ranking(kept, asked.where("query_id in ('a', 'b')"), 5)
    postings = kept.table("postings").join(ranking.wanted.select("query_id", "token"), "token")
    assert postings.join(ranking.live, ["query_id", "block"], "left_semi").count() < 0.6 * postings.count()


def files(kept, name="postings"):
    return {b: sorted(manifests.children(kept.spark, f"{kept.path}/{name}/bucket={b}/version={v}")) for b, v in kept.versions[name].items()}


def same(a, b):
    for name in index.TABLES:
        columns = [c.split()[0] for c in index.TABLES[name].split(", ")]
        assert rows(a.table(name).select("bucket", *columns)) == rows(b.table(name).select("bucket", *columns)), name


def test_an_update_equals_a_new_index_and_leaves_other_buckets_alone(spark, tmp_path):
    first = some_pages(7)
    shape = {"buckets": 8, "blocks": 4, "files": 2}
    old = index.update(spark, str(tmp_path / "a"), spark.createDataFrame(first, SCHEMA), **shape)
    changed = [("d3", 1, "quite new words"), ("d3", 2, "and more of them"), ("new", 1, "the of")]
    now = index.update(spark, old.path, spark.createDataFrame(changed + [p for p in first if p[0] == "d5"], SCHEMA), spark.createDataFrame([("d9",), ("never",)], "document_id string"))
    after = [p for p in first if p[0] not in ("d3", "d9")] + changed
    same(now, index.update(spark, str(tmp_path / "b"), spark.createDataFrame(after, SCHEMA), **shape))
    touched = {b for b in now.versions["pages"] if now.versions["pages"][b] != old.versions["pages"].get(b)}
    of = {r[0] for r in spark.createDataFrame([("d3",), ("d9",), ("new",)], "d string").select(F.pmod(F.xxhash64("d"), F.lit(8)).cast("string")).collect()}
    assert touched <= of and len(of) < 8
    assert {b: f for b, f in files(old).items() if b not in of} == {b: f for b, f in files(now).items() if b not in of}
    # The old version is whole until it is cleared away.
    assert old.table("pages").count() == len(first)
    assert index.vacuum(now) > 0 and index.vacuum(now) == 0
    same(index.open_index(spark, now.path), now)


def test_nothing_changed_writes_nothing_and_sync_drops_what_is_gone(spark, tmp_path):
    first = some_pages(9, docs=8)
    df = spark.createDataFrame(first, SCHEMA)
    old = index.sync(spark, str(tmp_path / "a"), df, buckets=4, blocks=4)
    assert index.sync(spark, old.path, df).number == old.number
    now = index.sync(spark, old.path, df.where("document_id <> 'd1'"))
    same(now, index.update(spark, str(tmp_path / "b"), df.where("document_id <> 'd1'"), buckets=4, blocks=4))


def test_a_failed_update_is_never_read(spark, tmp_path, monkeypatch):
    old = index.update(spark, str(tmp_path / "a"), spark.createDataFrame(some_pages(3, docs=5), SCHEMA), buckets=2, blocks=2)
    before = old.table("pages").count()

    def broken(*_):
        raise OSError("no space")

    monkeypatch.setattr(manifests, "publish", broken)
    with pytest.raises(OSError, match="no space"):
        index.update(spark, old.path, spark.createDataFrame([("x", 1, "words")], SCHEMA))
    monkeypatch.undo()
    assert index.open_index(spark, old.path).table("pages").count() == before
    assert index.vacuum(index.open_index(spark, old.path)) > 0


def test_two_writers_of_one_version(spark, tmp_path):
    manifests.publish(spark, str(tmp_path / "m"), 1, {"a": 1})
    with pytest.raises(FileExistsError):
        manifests.publish(spark, str(tmp_path / "m"), 1, {"a": 2})
    assert manifests.latest(spark, str(tmp_path / "m")) == (1, {"a": 1})
    assert manifests.latest(spark, str(tmp_path / "none")) == (0, None)


def test_an_empty_index(spark, tmp_path):
    none = index.update(spark, str(tmp_path / "a"), spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([("a", "w1")], "query_id string, query string")
    assert index.word_hits(none, asked).count() == 0
    assert index.substring_hits(none, [("a", "w1x")]).count() == 0
    assert index.bm25(none, asked, 3).count() == 0
    assert index.grammar_hits(none, [("a", '"w1 w2"')])[0].count() == 0


def test_files_and_blocks_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """No task sorts more than its part of the texts: twice the texts are twice the files."""
    monkeypatch.setattr(index, "PART", 200)
    monkeypatch.setattr(index, "BLOCK", 100)
    shapes = []
    for docs in (200, 400):
        pages = spark.createDataFrame([(f"d{i}", 1, "x" * 40) for i in range(docs)], SCHEMA)
        shapes.append(index._shape(pages, 8, None, None))
    assert shapes == [{"buckets": 8, "blocks": 64, "files": 5}, {"buckets": 8, "blocks": 64, "files": 10}]
    kept = index.update(spark, str(tmp_path / "a"), pages, buckets=1)
    assert kept.shape == {"buckets": 1, "blocks": 160, "files": 80}
    assert sum(len(f) for f in files(kept).values()) > 60
    assert index.term_hits(kept, [("t", "XXX")]).count() == 400


def test_trigrams_of_blocks_as_of_texts(spark, kept, pages):
    odd = spark.createDataFrame([("a", 1, "x\x00\x00y"), ("b", 1, "\U0001f600ab\nc"), ("c", 1, "İstanbul ß"), ("d", 1, None), ("e", 1, "ab")], SCHEMA)
    from paperweave.functions.text import text_of

    for some in (odd, pages):
        made = some.select(F.lit(3).alias("block"), F.lower(text_of(F.col("text"))).alias("_low")).mapInArrow(index._grams, "block int, gram string").distinct()
        low = [r[0] for r in some.select(F.lower(text_of(F.col("text")))).collect()]
        assert rows(made) == sorted({(3, x[i : i + 3]) for x in low for i in range(len(x) - 2)}, key=str)


def test_terms_beyond_the_basic_plane_are_found(spark, tmp_path):
    """A letter of two code units is one of a trigram's three."""
    kept = index.update(spark, str(tmp_path / "a"), spark.createDataFrame([("a", 1, "x \U0001f600AB y"), ("b", 1, "ab")], SCHEMA), buckets=1)
    assert rows(index.term_hits(kept, [("t", "\U0001f600ab")]).drop("text")) == [("t", "a", 1)]


def test_trigrams_are_made_before_the_first_substring_search(spark, tmp_path):
    """An index made for words alone has none, and later gives what one with trigrams gives, also after an update; a second search makes nothing."""
    first, changed = some_pages(5, docs=6), some_pages(6, docs=2)
    shape = {"buckets": 2, "blocks": 2, "files": 1}
    late, full = (index.update(spark, str(tmp_path / n), spark.createDataFrame(first, SCHEMA), trigrams=t, **shape) for n, t in (("late", False), ("full", True)))
    assert not manifests.children(spark, f"{late.path}/grams") and manifests.children(spark, f"{full.path}/grams")
    term = first[0][2][:5]
    assert rows(index.term_hits(late, [("t", term)])) == rows(index.term_hits(full, [("t", term)]))
    again = index.open_index(spark, late.path)
    same(again, full)
    assert index.with_trigrams(late).number == again.number
    late, full = (index.update(spark, x.path, spark.createDataFrame(changed, SCHEMA), trigrams=t) for x, t in ((late, False), (full, True)))
    same(index.with_trigrams(late), full)
    index.vacuum(index.open_index(spark, late.path))
    same(index.open_index(spark, late.path), full)


def shuffled(spark):
    """MB that all tasks so far have shuffled, and those whose shuffle files are still there."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    there = sum(f.stat().st_size for d in sc.env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data"))
    return sc.statusStore().executorList(True).head().totalShuffleWrite() / 1e6, there / 1e6


def test_texts_are_shuffled_once_and_shuffles_end_with_their_write(spark, tmp_path):
    """A new index shuffles its texts once and no postings; an update shuffles the given pages twice and the stored ones once. What is shuffled does not wait for garbage to be collected."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    pages = spark.createDataFrame([(f"d{d}", 1, " ".join(r.choices(words, k=100))) for d in range(4000)], SCHEMA)
    changed = pages.where("cast(substring(document_id, 2) as int) % 4 = 0").withColumn("text", F.concat("text", F.lit(" more")))
    began, _ = shuffled(spark)
    pages.repartition(4, "document_id").write.format("noop").mode("overwrite").save()
    once = shuffled(spark)[0] - began
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    began, left = shuffled(spark)
    old = index.update(spark, str(tmp_path / "a"), pages, buckets=2, blocks=16, files=2, trigrams=False)
    built, after = shuffled(spark)
    assert built - began < 1.3 * once
    now = index.update(spark, old.path, changed, trigrams=False)
    updated, after = shuffled(spark)
    assert updated - built < 1.9 * once
    assert after - left < 0.2 * once
    assert now.table("blocks").where("token = 'more'").agg(F.sum("df")).first()[0] == 1000


def test_small_batches_make_the_same_index(spark, tmp_path):
    """A block's rows of one token, and a block's trigrams, lie in many batches: each comes once."""
    pages = spark.createDataFrame(some_pages(11, docs=12), SCHEMA)
    shape = {"buckets": 2, "blocks": 2, "files": 2}
    want = index.update(spark, str(tmp_path / "a"), pages, **shape)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"}):
        made = index.update(spark, str(tmp_path / "b"), pages, **shape)
    same(made, want)
    for name, key in (("blocks", ["token", "block"]), ("grams", ["gram", "block"])):
        assert made.table(name).groupBy(key).count().where("count > 1").isEmpty()
    p = made.table("postings").select("token", "block", "n", F.size(F.filter("positions", lambda x: x >= 0)).alias("tf"))
    counted = p.groupBy("token", "block").agg(F.count("*"), F.count_if(F.col("tf") > 0), F.max("tf"), F.min("n"))
    assert rows(made.table("blocks").drop("bucket", "version")) == rows(counted)


def test_an_update_of_repeated_missing_and_empty_pages(spark, tmp_path):
    """Pages that a changed document lost go, with texts that are null or repeated; a document among the given that is as before stays; one both given and gone stays."""
    shape = {"buckets": 2, "blocks": 4, "files": 2}
    first = [("a", 1, "one"), ("a", 2, "two"), ("a", None, "of no page"), ("b", 1, None), ("c", 1, "same"), ("c", 1, "Same"), ("d", 1, "stays"), ("e", 1, "text"), ("f", 1, "not given")]
    given = [("a", 2, "x"), ("a", 2, "y"), ("a", 2, None), ("b", 1, ""), ("b", 1, None), ("c", 1, "same"), ("d", 1, "stays"), ("e", 1, None)]
    old = index.update(spark, str(tmp_path / "a"), spark.createDataFrame(first, SCHEMA), **shape)
    now = index.update(spark, old.path, spark.createDataFrame(given, SCHEMA), spark.createDataFrame([("d",), ("f",)], "document_id string"))
    after = [("a", 2, "y"), ("b", 1, ""), ("c", 1, "same"), ("d", 1, "stays"), ("e", 1, None)]
    same(now, index.update(spark, str(tmp_path / "b"), spark.createDataFrame(after, SCHEMA), **shape))
    assert rows(now.table("pages").select("document_id", "page_no", "text")) == after


def test_the_updated_index_alone_stays(spark, tmp_path, monkeypatch):
    from paperweave.plans import queries_packets

    spark.createDataFrame([(i, f"text of {i}") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(queries_packets, "shared_dir", lambda _: str(tmp_path / "shared"))
    found = dict(rows(queries_packets.page_index_update(spark, str(tmp_path))))
    assert (found["text"], found["reviewed"], found.get("7")) == (34, 17, None)
    for name in index.TABLES:
        versions = [f.relative_to(tmp_path / "shared").parts[2:] for f in (tmp_path / "shared").glob(f"page-index-*/{name}/bucket=*/version=*")]
        assert any(v.startswith("version=v2") for _, v in versions) and len({b for b, _ in versions}) == len(versions), name
