"""Lexical search, importance resampling and SimHash against plain versions, and their stated cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paperweave.llm import importance, lexical_search, queries, simhash

SMALL = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(A_TO_Z)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- ranked lexical search ------------------------------------------------------------------------------------------------
def plain_search(docs, items, limit=10):
    tf = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    df, n = Counter(t for _, c in tf for t in c), sum(1 for _, c in tf if c)
    words = sum(c.total() for _, c in tf)
    out = []
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall(low(text)))
    for item, asked in terms.items():
        scored = []
        for i, c in tf:
            m = 100 - 90 + (90 * c.total() * n) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=str)


def test_search_as_a_plain_search(spark, docs, monkeypatch):
    r = random.Random(3)
    some = [(i, t) for i, t in docs.select("doc_id", "text").collect()]
    items = [(k, " ".join(r.choice(["w1", "w2", "The", "of", "émile", "Émile", "org", "zzz", f"w{r.randint(0, 400)}"]) for _ in range(r.randint(0, 9)))) for k in range(40)] + [(None, "w5 w6"), (None, "w7"), (99, None), (98, "zzz"), (1, "w9")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical_search.ranked(docs, asked)) == plain_search(some, items)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)
    assert rows(lexical_search.ranked(docs, asked, 3)) == plain_search(some, items, 3)


def test_search_ties_repeated_rows_nulls_and_clashing_names(spark):
    some = [(5, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (4, None), (6, ""), (7, "beta " * 50_000)]
    wide = spark.createDataFrame(some, "doc_id long, text string").select("*", *[F.lit("v").alias(c) for c in ("n", "terms", "counts", "rank", "score", "item_id", "a.b")])
    items = [(1, "alpha"), (2, "BETA")]
    found = lexical_search.ranked(wide, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("v")))
    assert rows(found) == plain_search(some, items)
    assert [r["doc_id"] for r in found.where("item_id = 1").orderBy("rank").collect()] == [3, 3, 5, None]


def test_search_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.ranked(docs, none).count() == 0
    assert lexical_search.ranked(empty, none).count() == 0
    assert lexical_search.ranked(empty, spark.createDataFrame([(1, "w1")], "item_id long, text string")).count() == 0


def test_bounds_are_never_below_the_score_and_few_documents_are_rescored(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    batch = docs.select("doc_id", "text").limit(400).toArrow().to_batches()[0]
    index = next(lexical_search._index_rows(iter([batch])))
    terms, size = lexical_search._values(index.column(2), np.uint64)
    counts = lexical_search._values(index.column(3), np.uint32)[0].astype(np.int64)
    doc = np.repeat(np.arange(index.num_rows), size)
    m = 10 + 90 * index.column(1).to_numpy() * index.num_rows // int(index.column(1).to_numpy().sum())
    asked = np.unique(terms)[::50]
    block = lexical_search.Block([0], [np.arange(len(asked))], asked, np.full(len(asked), 7001))
    bound = lexical_search.bounds(doc, terms, counts, m, block.matrix())[:, 0]
    exact = np.zeros(index.num_rows)
    some = np.isin(terms, asked)
    np.add.at(exact, doc[some], 7001 * (1_000_000_000 * counts[some] // (1000 * counts[some] + 8 * m[doc[some]])))
    assert (bound >= exact).all()
    tried = []
    add = lexical_search.Best.add
    monkeypatch.setattr(lexical_search.Best, "add", lambda self, s, i, n: (tried.append(len(s)), add(self, s, i, n))[1])
    places = [np.arange(k, len(asked), 40) for k in range(20)]
    run = lexical_search._search(lexical_search.Block(list(range(20)), places, asked, np.full(len(asked), 7001)), index.num_rows, int(index.column(1).to_numpy().sum()), 10)
    list(run(iter([index])))
    assert sum(tried) < 0.5 * 20 * index.num_rows


# --- importance resampling ------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, runs):
    w = WORD.findall(low(text))
    return len(w), w + ([f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] if runs == 2 else [])


def plain_resample(docs, target, runs=1, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    of = [(i, *plain_features(t, runs)) for i, t in docs]
    s, t = Counter(bucket(f) for *_, x in of for f in x), Counter(bucket(f) for x in target for f in plain_features(x, runs)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10_000) / ((s[b] + 1.0) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, x in of:
        weight = sum(gain[bucket(f)] for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("runs", [1, 2])
def test_resampling_as_a_plain_version(spark, docs, runs):
    some = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(None, "w1 w2 " * 15), (3, "w9 the " * 400), (3, "w9 the " * 400), (200, "W1" * 500 + " b")]
    target = ["w1 w2 the of", "Émile w3 w4", None, ""]
    wide = spark.createDataFrame(some, "doc_id long, text string").repartition(3).select("*", *[F.lit("v").alias(c) for c in ("n_words", "n_features", "buckets", "tie", "score", "rank", "weight", "a.b")])
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(wide, goal, runs, percent=40)
    assert rows(found) == plain_resample(some, target, runs, percent=40)
    assert sorted(r["rank"] for r in found.where("rank is not null").collect()) == list(range(1, found.where("rank is not null").count() + 1))


def test_resampling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    some = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(importance.resample(docs, none)) == plain_resample(some, [])
    assert importance.resample(docs, none, least_words=10_000).where("rank is not null").count() == 0


def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(7, "a b c " * 10)] * 50 + [(None, "a b c " * 10)] * 50, "doc_id long, text string").repartition(4)
    found = importance.resample(df, spark.createDataFrame([("a",)], "text string"), percent=30).where("rank is not null")
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 31))


def test_head_and_tail_give_the_same_buckets(docs):
    texts = pa.array([t for (t,) in docs.select("text").collect()])
    words = importance.Words(texts)
    head = importance.head_of(docs.select("text"), 2)
    assert len(head.words) and len(head.pairs)
    none = importance.Head()
    a, b = importance.word_states(words, head), importance.word_states(words, none)
    assert (a == b).all()
    assert [int(~x) & 0xFFFFFFFF for x in a] == [zlib.crc32(words.data[s:e].tobytes()) for s, e in zip(words.start, words.end, strict=True)]
    assert all((x == y).all() for x, y in zip(importance.pair_buckets(words, a, head, 10_000), importance.pair_buckets(words, b, none, 10_000), strict=True))


# --- SimHash --------------------------------------------------------------------------------------------------------------
def plain_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Of (id, print): component by id."""
    top = {i: i for i, _ in prints if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if i is not None and j is not None and (x ^ y).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in top}


def check_components(found, docs):
    prints = [(i, plain_print(t)) for i, t in docs]
    comp = plain_components(prints)
    assert rows(found.select("doc_id", simhash.as_hex(F.col("print")), "component_id")) == sorted(((i, f"{p:016x}", comp.get(i)) for i, p in prints), key=str)


def test_simhash_as_a_plain_version(spark, docs, empty):
    some = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(None, None), (None, "a b c"), (3, "x y z"), (900, "x\ty\n\nZ"), (901, "a b"), (901, "q r s t")]
    wide = spark.createDataFrame(some, "doc_id long, text string").select("*", *[F.lit("v").alias(c) for c in ("print", "rep", "key", "way", "n", "_large", "component_id", "a.b")])
    check_components(simhash.near_duplicates(wide), some)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_the_documents(spark):
    some = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    found = simhash.near_duplicates(some)
    assert found.where("component_id <> doc_id").count() > 10
    check_components(found, [tuple(r) for r in some.collect()])
    assert queries.op13_simhash_near_dedup(spark, SMALL).columns == ["doc_id", "fingerprint", "component_id"]


def cube(n, bits, seed, others=0):
    """n prints that differ in a few bits of one, and others at random."""
    r = np.random.default_rng(seed)
    base, at = r.integers(0, 1 << 63, dtype=np.uint64), r.choice(64, bits, replace=False).astype(np.uint64)
    x = np.unique(np.concatenate([base ^ np.array([np.bitwise_or.reduce(np.where(r.random(bits) < 0.3, np.uint64(1) << at, np.uint64(0))) for _ in range(n)]), r.integers(0, 1 << 63, others, dtype=np.uint64)]))
    return x


@pytest.mark.parametrize(("n", "bits"), [(600, 12), (800, 30), (500, 64)])
def test_trie_finds_every_pair(n, bits, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    x = cube(n, bits, n, 300)
    found = {tuple(sorted(p)) for a, b in simhash.trie_join(np.zeros(len(x), np.int64), x) for p in zip(a.tolist(), b.tolist(), strict=True)}
    differ = np.bitwise_count(x[:, None] ^ x[None, :])
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(differ <= 3), strict=True) if i < j}


def test_large_groups_are_cut_without_losing_a_link(spark, monkeypatch):
    """A family in which most prints share any piece: groups of at most 50 after several cuts."""
    monkeypatch.setattr(simhash, "MOST", 50)
    x = cube(1500, 14, 5, 200)
    classes = spark.createDataFrame([(int(v) - (1 << 64) if int(v) >> 63 else int(v), i) for i, v in enumerate(x)], "print long, rep long")
    groups, _ = simhash._groups(classes)
    assert groups.groupBy("key").count().agg(F.max("count")).first()[0] <= 50
    links = groups.repartition("key").sortWithinPartitions("key").mapInArrow(simhash._joined, "a long, b long").collect()
    label = simhash.connected(len(x), iter([(np.array([r["a"] for r in links]), np.array([r["b"] for r in links]))]))
    differ = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = simhash.connected(len(x), iter([np.nonzero(differ)]))
    assert (label == want).all() and len(np.unique(want)) > 1


def test_every_pair_within_the_budget_shares_a_group():
    r = np.random.default_rng(1)
    for depth in (1, 2, 3):
        masks = simhash.piece_masks(depth)
        assert len(masks) == 4**depth
        for _ in range(300):
            differ = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(m & differ == 0 for m in masks)


def test_sets_of_too_different_sizes_are_never_compared(spark):
    from paperweave.llm import near_dedup

    members = spark.createDataFrame([(1, 1, 1, 100), (1, 2, 2, 70), (1, 3, 3, 80)], "band long, rep long, comp long, size long")
    sets = spark.createDataFrame([], "rep long, shingles binary")
    assert {tuple(r) for r in near_dedup._rest(members, sets).select("a", "b").collect()} == {(1, 3), (2, 3)}
