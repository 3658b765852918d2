"""Odd inputs of every operator and pipeline stage, brute-force versions and held-out accuracy."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from paperweave.llm import bpe, common, exact_dedup, langid, near_dedup, packing, pii, quality, queries, token_output, toxicity
from paperweave.llm.queries import BYTE_BPE, WORD_BPE

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=80):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_stage_keeps_unrelated_rows_and_one_of_each_text(spark):
    df = frame(spark, [(1, "alpha"), (1, "beta"), (2, "alpha"), (None, "g"), (None, "g"), (5, "z"), (5, "z"), (None, None), (None, "")])
    left = texts(cp.exact_duplicates(spark, df, ""))
    assert [x for x in left if x[1]] == [(1, "beta"), (2, "alpha"), (5, "z"), (None, "g")] and len(left) == 5


def test_near_stage_keeps_unrelated_rows_and_one_of_each_group(spark):
    a = words(1)
    df = frame(spark, [(1, a), (2, a + " tail"), (2, words(2)), (None, words(3)), (None, words(3)), (None, words(4))])
    assert texts(cp.near_duplicates(spark, df, "")) == sorted([(1, a), (2, words(2)), (None, words(3)), (None, words(4))], key=str)


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_stages_with_odd_tables(spark, name, stage):
    """Empty tables; nulls in every column; names that clash with any of ours, or hold dots and quotes."""
    empty = spark.createDataFrame([], COLUMNS)
    assert stage(spark, empty, "").count() == 0
    odd = frame(spark, [(1, words(1)), (2, words(1)), (None, None), (3, ""), (4, words(2) + " call +1 (212) 555-0123"), (5, words(9, 20_000))])
    none = odd.withColumns({c: F.lit(None).cast(odd.schema[c].dataType) for c in ("lang", "source", "n_chars")})
    clashes = ["base", "spans", "row", "number", "_found", "_before", "_clean", "_suspect", "_bucket", "_bits", "_key", "_n", "kept", "id", "a.b", "q`t", "group_size", "n_words", "_text"]
    wide = none.select("*", *[F.lit("v").alias(c) for c in clashes])
    out = stage(spark, wide, "")
    rows = out.collect()
    if name != "packing":
        assert out.columns == wide.columns and all(r[c] == "v" for r in rows for c in clashes)
        plain = stage(spark, none, "")
        assert texts(plain) == sorted([(r["doc_id"], r["text"]) for r in rows], key=str)
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, None} and rows


def test_operators_ignore_clashing_columns(spark):
    docs = frame(spark, [(1, words(1)), (2, words(1)), (3, None), (None, "mail a@b.org")])
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("kept", "_key", "_text", "ids", "row", "base", "score", "set_key", "bands", "number", "a.b", "_length", "toxic")])
    marks = spark.createDataFrame([(1, 1, 9), (3, 0, 9)], "doc_id long, toxic int, score int")
    for run in (exact_dedup.exact_duplicates, near_dedup.near_duplicates, pii.find, quality.quality, langid.predict, lambda d: toxicity.score(d, marks), lambda d: bpe.round_trip(d, WORD_BPE), lambda d: packing.pack(d, BYTE_BPE)):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(docs).collect()))


def test_personal_data_is_linear_in_matches(spark):
    n = 40_000
    rows = [(1, "12," * n), (2, "1.2.3.4 " * n), (3, "a@b.cd " * n), (4, "+1 212 555 0123, 212-555-0199 " * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["n"] for r in pii.find(df, weights=[1.0] * 10).select("doc_id", F.size("spans").alias("n")).collect()}
    assert found == {1: 0, 2: n, 3: n, 4: 2 * n}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, weights=[1.0] * 10).collect()}
    assert clean[1] == rows[0][1] and clean[2] == "<IP> " * n and clean[4] == "<PHONE>, <PHONE> " * n
    assert time.time() - began < 60


def test_added_spans_are_those_of_a_plain_version(spark):
    r = random.Random(8)
    bits = ["bob (at) ex (dot) com", "212-555-0199", "x@y.zz", "4111.1111.1111.1111", "4111 1111 1111 1111", "call ", " ", "é", "1.2.3.4", "😀", ", ", "a:b:c:d:e:f:1:2", "order ", "+1 212 555 0199"]
    docs = spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randint(1, 40)))) for i in range(300)], "doc_id long, text string")
    weights = pii.train(pii.vote_table(pii.candidates(docs)))
    votes = {x["doc_id"]: x["_found"] for x in pii.candidates(docs).select("row.doc_id", "_found").collect()}
    n_added = 0
    for x in pii.find(docs, weights=weights).collect():
        base = [(c["s"], c["k"], c["e"]) for c in votes[x["doc_id"]] if c["strict"] and c["v1"] == 1]
        likely = lambda c: 1 / (1 + np.exp(-(weights[c["k"]] + sum(weights[4 + 2 * i + c[f"v{i + 1}"]] for i in range(3) if c[f"v{i + 1}"] >= 0)))) >= pii.THRESHOLD
        added = [(c["s"], c["k"], c["e"]) for c in votes[x["doc_id"]] if not c["strict"] and likely(c) and not any(s < c["e"] and c["s"] < e for s, _, e in base)]
        assert [tuple(s) for s in x["spans"]] == sorted(base + added) and [tuple(s) for s in x["base"]] == sorted(base)
        for c in votes[x["doc_id"]]:
            assert x["text"][c["s"] : c["e"]] == c["t"]
        n_added += len(added)
    assert n_added > 50


def test_families_just_below_the_threshold_make_no_pairs(spark):
    """Members share 340 of their 400 shingles, 0.739 of the union: never linked, and no pair reaches the comparison of sets."""
    core = [f"c{i}" for i in range(344)]
    rows = [(i, " ".join(core + [f"u{i}x{k}" for k in range(60)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert near_dedup.near_duplicates(df).where("kept").count() == len(rows)
    sets = df.select("doc_id", "text").mapInArrow(near_dedup._set_rows, "rep long, shingles binary")
    assert near_dedup._prefix_pairs(df.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp")), sets).count() == 0


def test_families_about_the_threshold_lose_no_link_and_are_not_expanded(spark, monkeypatch):
    """Members that each leave out another random part of one text: a quarter of their pairs are links, most others come close. Components are those of all pairs, with a quarter of all pairs compared at most."""
    asked, verify = [], near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, sets: asked.append(pairs.count()) or verify(pairs, sets))
    r, n = np.random.default_rng(5), 400
    core = np.array([f"c{i}" for i in range(400)])
    texts = [" ".join(np.concatenate([b for b in np.split(core, 80) if r.random() > 0.075])) for _ in range(n)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    least = list(range(n))
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and least[a] != least[b]:
                lo, hi = sorted((least[a], least[b]))
                least = [lo if c == hi else c for c in least]
    assert got == dict(enumerate(least))
    assert len(asked) >= 3 and sum(asked) < n * (n - 1) / 2 / 4, asked


def test_pairs_meet_their_sets_once(spark, tmp_path):
    """The join of pairs with their first sets is made once, not again for the heavy ids and the needed sets of the second."""
    spark.createDataFrame([(1, 2), (1, 3)], "a long, b long").write.parquet(str(tmp_path / "pairs"))
    full = np.arange(40, dtype=np.int64)
    spark.createDataFrame([(1, bytearray(full.tobytes())), (2, bytearray(full[:36].tobytes())), (3, bytearray(full[:20].tobytes()))], "rep long, shingles binary").write.parquet(str(tmp_path / "sets"))
    found = near_dedup.verify(spark.read.parquet(str(tmp_path / "pairs")), spark.read.parquet(str(tmp_path / "sets")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [rep#") == 2
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_sketches_leave_out_pairs_that_are_no_links_and_lose_none(spark):
    """Sets 1 and 2 share their 70 rarest shingles of 100, which is no link, and never become a pair; 3 and 4 share 95 and do."""
    rng = np.random.default_rng(5)
    rare, b, c, most, *own = (rng.integers(-(1 << 62), 1 << 62, n) for n in (70, 30, 30, 95, 5, 5, 300, 300, 300))
    listed = [(rare, b), (rare, c), (most, own[0]), (most, own[1]), *((b, c, x) for x in own[2:])]  # the last three make b and c frequent
    sets = {i: np.sort(np.concatenate(s)) for i, s in enumerate(listed, 1)}
    nodes = spark.createDataFrame([(i, i) for i in sets], "rep long, comp long")
    pairs = near_dedup._prefix_pairs(nodes, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "rep long, shingles binary"))
    assert {tuple(r) for r in pairs.collect()} == {(3, 4)}
    for x in sets.values():
        for y in sets.values():
            differ = sum(((p ^ q) & ((1 << 64) - 1)).bit_count() for p, q in zip(near_dedup.sketch(x), near_dedup.sketch(y), strict=True))
            assert differ <= len(np.setxor1d(x, y))


def test_recall_of_the_bands():
    """Pairs at or just above the threshold share a band; 40 bands of 5 rows miss 2 in 100,000."""
    r = np.random.default_rng(3)
    caught = 0
    for _ in range(2000):
        common_part, own = r.integers(0, 1 << 62, 90).astype(np.uint64), r.integers(0, 1 << 62, 30).astype(np.uint64)
        a, b = (near_dedup.signature(np.concatenate([common_part, own[k * 15 : k * 15 + 15]])).reshape(near_dedup.BANDS, near_dedup.ROWS) for k in (0, 1))
        caught += bool((a == b).all(axis=1).any())
    assert caught >= 1998


def test_hot_keys_are_joined_by_broadcast(spark):
    many = spark.range(10_000).selectExpr("if(id % 3 = 0, 7, id) as k", "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    plain = many.join(one.drop("n"), "k")
    for how in ("inner", "left"):
        assert sorted(common.join_heavy(many, one, "k", "n", 10_000, how).collect()) == sorted(plain.collect())
    assert common.join_heavy(many, one.where("k = 7"), "k", "n", 10_000, "left").count() == 10_000


def test_only_ids_of_16_bits_are_narrowed():
    assert token_output.narrow(np.array([1, 65535], "<u4").tobytes()) == np.array([1, 65535], "<u2").tobytes()
    with pytest.raises(ValueError):
        token_output.narrow(np.array([65536], "<u4").tobytes())


def test_little_padding(spark):
    pieces = packing.pack(common.table(spark, SMALL, "documents"), BYTE_BPE)
    used, sequences = pieces.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used / (sequences * packing.LENGTH) > 0.97


def test_language_of_held_out_rows(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "lang")
    held = queries.op4_language_id(spark, SMALL).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.98


def test_language_scores_are_those_of_the_plain_kernel():
    """The folded matrix against kernels counted on sets of n-grams; a long text is the mean of its windows."""
    r = random.Random(1)
    speech = {"aa": "the thing of that was".split(), "bb": "der die und nicht ist".split()}
    train = [(" ".join(r.choice(speech[g]) for _ in range(12)), g) for _ in range(30) for g in sorted(speech)]
    model = langid.fit([t for t, _ in train], [g for _, g in train])

    def grams(codes):
        row = np.zeros(langid.BUCKETS, np.uint8)
        langid.presence(codes, row)
        return set(np.flatnonzero(row).tolist())

    long = " ".join(r.choice(speech["aa"] + speech["bb"]) for _ in range(3000))
    for text in ("the und of", long):
        parts = langid.windows(text)
        plain = np.mean([sum(model.weights[sorted(grams(p))].astype(float)) / np.sqrt(len(grams(p))) + model.bias for p in parts], axis=0)
        assert np.allclose(plain, langid.scores(model, [text])[0], atol=1e-3)
    assert sum(map(len, langid.windows(long))) == len(long) and len(langid.windows(long)) > 3
    assert langid.scores(model, ["the thing of that"]).argmax() == 0 and langid.scores(model, ["und nicht ist"]).argmax() == 1


def test_toxicity_of_held_out_rows(spark):
    marks = common.table(spark, MIDDLE, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = queries.op6_toxicity(spark, MIDDLE).where("held_out").join(marks, "doc_id").select("score", "toxic").collect()
    good, bad = [r["score"] for r in held if not r["toxic"]], [r["score"] for r in held if r["toxic"]]
    assert bad and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.9
    assert sum(g >= 0.5 for g in good) / len(good) < 0.05


def test_naming_a_group_moves_no_score(spark):
    """Swapping a named group in a neutral sentence changes the score by next to nothing, though it is named far more often in toxic texts."""
    r = random.Random(6)
    plain = [f"n{i}" for i in range(50)]
    rows = [(i, " ".join([r.choice(plain) for _ in range(20)] + (["idiot", "women"] if i % 4 == 0 else ["fine"]))) for i in range(400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.sample(docs, marks))
    asked = spark.createDataFrame([(0, "women are here"), (1, "men are here"), (2, "idiot")], "doc_id long, text string")
    found = {x["doc_id"]: x["score"] for x in toxicity.score(asked, marks, model).collect()}
    assert abs(found[0] - found[1]) < 0.2 and found[0] < 0.5 < found[2]


def test_chosen_words_are_those_of_a_plain_count(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    marks = common.table(spark, "/root/testdata/sf0.001", "labels").where("toxic is not null")
    got = toxicity.sample(docs, marks)
    label = {r["doc_id"]: r["toxic"] for r in marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(toxicity.crc_mod("doc_id", 5) != 0).collect()}
    rows = [(set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))), label[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in label]
    n = {}
    for have, y in rows:
        for w in have:
            a, b = n.get(w, (0, 0))
            n[w] = a + 1, b + y
    share = sum(y for _, y in rows) / len(rows)
    z = {w: abs(b - a * share) / np.sqrt(a * share * (1 - share) + 1) for w, (a, b) in n.items() if a >= toxicity.LEAST_ROWS}
    chosen = set(got.features.tolist())
    hashed = dict(zip(z, toxicity._hash_words(list(z)).tolist(), strict=True))
    taken, left = [z[w] for w in z if hashed[w] in chosen], [z[w] for w in z if hashed[w] not in chosen]
    assert len(rows) == len(got.toxic) and min(len(z), toxicity.FEATURES) <= len(chosen)
    assert not left or sorted(taken)[-toxicity.FEATURES] >= max(left) - 1e-9


def test_quality_verdict_is_that_of_a_plain_version(spark, docs, texts):
    """References, distances and verdicts counted with plain dictionaries."""
    quality_rows = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))

    def classes(t):
        out = [0] * 8
        for c in t or "":
            b = ord(c)
            out[7 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if b < 32 else 5 if c in ".,:;!?'\"()-" else 6] += 1
        return out

    langs = {i: "en" if i % 3 else "de" for i in range(len(texts))}
    refs = []
    for lang in ("de", "en"):
        mine = [texts[i] for i in langs if langs[i] == lang]
        counts = {}
        for t in mine:
            for w in split(t):
                counts[w] = counts.get(w, 0) + 1
        total = sum(counts.values())
        if total < quality.REFERENCE_WORDS:
            continue
        edge = sorted(counts.values(), reverse=True)[quality.COMMON_WORDS - 1]
        chars = np.sum([classes(t) for t in mine], axis=0)
        refs.append((chars / chars.sum(), counts, edge, total))
    js = lambda p, q: np.sqrt(max(0, sum((x * np.log2(2 * x / (x + y)) if x else 0) + (y * np.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2))
    assert refs
    judged = {lang for lang in ("de", "en") if sum(len(split(texts[i])) for i in langs if langs[i] == lang) >= quality.REFERENCE_WORDS}
    for i, t in enumerate(texts):
        if langs[i] not in judged:
            assert quality_rows[i]["char_distance"] == quality_rows[i]["word_distance"] == 0 and quality_rows[i]["kept"] == (not quality_rows[i]["base_failed"])
            continue
        c, w = np.array(classes(t)), split(t)
        best = min((js(c / c.sum(), r[0]) if c.sum() >= quality.GUARD_CHARS else 0.0) for r in refs)
        assert quality_rows[i]["char_distance"] >= best - 1e-9
        if quality_rows[i]["char_distance"] == 0:
            assert c.sum() < quality.GUARD_CHARS or best < 1e-6
        if len(w) < quality.GUARD_WORDS:
            assert quality_rows[i]["word_distance"] == 0
        over = quality_rows[i]["char_distance"] > quality.MAX_CHAR_DISTANCE or quality_rows[i]["word_distance"] > quality.MAX_WORD_DISTANCE
        assert quality_rows[i]["kept"] == (not quality_rows[i]["base_failed"] and not over)
    if len(refs) == 1:  # one reference: distances are exactly those
        for i, t in enumerate(texts):
            c = np.array(classes(t))
            if c.sum() >= quality.GUARD_CHARS and langs[i] in judged:
                assert abs(quality_rows[i]["char_distance"] - js(c / c.sum(), refs[0][0])) < 1e-9


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from paperweave.session import shared_dir

    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://somewhere:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_dir(Remote())


def test_written_tables_can_be_discarded(spark):
    import os

    df = common.materialize(spark.range(10), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    common.discard(df)
    assert not os.path.exists(path)


def test_written_tables_leave_the_sessions_batch_size(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for mine in ("7", "0", "50000"):
        spark.conf.set(name, mine)
        assert sorted(r[0] for r in common.materialize(spark.range(3), "t").collect()) == [0, 1, 2]
        assert spark.conf.get(name) == mine
    spark.conf.set(name, before)
