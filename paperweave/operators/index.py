"""A page index that is kept between queries and brought up to date document by document.

A document lives in one bucket, a hash of its id, and a page in one block of its bucket. Five tables, each cut by bucket and version:

  pages     document_id, page_no, text, digest, n (tokens of the text), block
  postings  token, document_id, page_no, block, n, positions (those of the id's tokens are negative)
  blocks    token, block, df (pages), text_df (pages with it in the text), most_tf, least_n
  grams     gram (three letters in a row), block
  counts    gram, df (blocks)

Pages are sorted by block and the others by their key inside each file, so a filter on few of them reads few row groups. A file
is made of some PART letters of text and a block of BLOCK, whatever the size of the table: no task's sort grows with it. Texts are dealt out
once, for the pages; postings and blocks are made file by file of what is written, without a shuffle. Where a file is read in pieces all the same, a token may
have two rows of one block, which every reader adds up. An update writes new
files for the buckets of changed documents alone and then publishes a manifest that names the version of each bucket; until
then readers see the old one, and a failed update leaves nothing that is read. Only substring searches read grams and counts: an index of
which words alone are asked may be made without them, and gets them from its pages before the first substring search.

Searches start from the rarest token of a query, or the blocks that have its rarest trigrams, and test the rest on what is left; BM25 skips blocks whose
bound is below the score of the last place. Terms of one or two letters have no trigram: they are searched in the texts themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..session import settings, unwrite, written
from ..sources import manifests
from . import search

#: Blocks of a bucket and files of a bucket and table, at least, and the letters of text beyond which there are more.
BUCKETS, BLOCKS, FILES = 8, 64, 4
BLOCK, PART = 2 << 20, 16 << 20
#: Keys up to which a filter is stated as a list, which files are pruned by; beyond it, it is a join.
MOST_STATED = 1000
#: Of a term's trigrams so many, the rarest, choose its candidates.
RAREST = 3
#: Blocks of a query that are scored first, for a score that others must reach.
SEEDS = 8
TABLES = {
    "pages": "document_id string, page_no long, text string, digest long, n int, block int",
    "postings": "token string, document_id string, page_no long, block int, n int, positions array<int>",
    "blocks": "token string, block int, df long, text_df long, most_tf int, least_n int",
    "grams": "gram string, block int",
    "counts": "gram string, df long",
}
PAGE = ["document_id", "page_no"]
#: While a table is made of another one's files, each of these is one task, whatever its size.
WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}
#: What a write has shuffled goes with its end, not when the driver happens to collect its garbage.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: No table: the buckets whose grams and counts are made, with the version of these.
TRIGRAMS = "trigrams"


@dataclass(frozen=True)
class PageIndex:
    spark: SparkSession
    path: str
    number: int
    shape: dict
    #: table -> bucket -> version
    versions: dict

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        at = [f"{self.path}/{name}/bucket={b}/version={v}" for b, v in self.versions.get(name, {}).items() if buckets is None or int(b) in buckets]
        if not at:
            return self.spark.createDataFrame([], TABLES[name] + ", bucket int, version string")
        return self.spark.read.schema(TABLES[name] + ", bucket int, version string").option("basePath", f"{self.path}/{name}").parquet(*at)


def open_index(spark: SparkSession, path: str) -> PageIndex | None:
    number, content = manifests.latest(spark, path)
    return PageIndex(spark, path, number, content["shape"], content["versions"]) if content else None


def _digests(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("n"), F.bit_xor("digest").alias("digest"))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens, once each, with their positions, from the list of its tokens: those of a batch are sorted by page and token as numbers."""
    for batch in batches:
        listed, own = batch.column("_tokens"), batch.column("_own").to_numpy()
        sizes = pc.list_value_length(listed).to_numpy()
        coded = listed.flatten().dictionary_encode()
        page = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes + own, sizes)
        key = page * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        lead = order[first]
        rows = batch.select(["bucket", "block", *PAGE, "n"]).take(pa.array(page[lead]))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([*rows.columns, coded.dictionary.take(coded.indices.take(pa.array(lead))), positions], [*rows.schema.names, "token", "positions"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and token of (block, token, tf, n) whose rows follow one another, as they do in a file of postings."""
    last = None
    for batch in chain(batches, [None]):
        rows = batch if last is None else last if batch is None else pa.concat_batches([last, batch])
        if not rows:
            continue
        block, token, tf, n = rows.columns
        code = token.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block.to_numpy(), prepend=-1) != 0))
        last, done = rows[first[-1] :], len(first) - (batch is not None)
        tf, n = tf.to_numpy(), n.to_numpy()
        summed = np.diff(first, append=len(tf)), np.add.reduceat(tf > 0, first, dtype=np.int64), np.maximum.reduceat(tf, first), np.minimum.reduceat(n, first)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in (block, token)), *map(pa.array, summed)], ["block", "token", "df", "text_df", "most_tf", "least_n"])[:done]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) of texts in lower case: three code points in a row of one page, as numbers. Each comes once for a block whose texts follow one another."""
    held, of_held = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows(block: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        distinct, of = np.unique(code, return_inverse=True)
        names = pa.array([chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in distinct.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), names.take(pa.array(of))], ["block", "gram"])

    for batch in batches:
        texts = batch.column("_low")
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = pc.utf8_length(texts).to_numpy()
        page = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.flatnonzero(page[:-2] == page[2:])
        code = np.concatenate([held, points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2]])
        block = np.concatenate([of_held, batch.column("block").to_numpy()[page[inside]].astype(np.int64)])
        distinct, of = np.unique(code, return_inverse=True)
        block, of = np.divmod(np.unique(block * max(1, len(distinct)) + of), max(1, len(distinct)))
        code, last = distinct[of], block == block[-1:]
        held, of_held = code[last], block[last]
        yield rows(block[~last], code[~last])
    yield rows(of_held, held)


def _shape(pages: DataFrame, buckets: int, blocks: int | None, files: int | None) -> dict:
    if blocks is None or files is None:
        letters = pages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        files = files or max(FILES, -(-letters // (buckets * PART)))
        blocks = blocks or max(BLOCKS, files, -(-letters // (buckets * BLOCK)))
    return {"buckets": buckets, "blocks": blocks, "files": files}


def _dealt(rows: DataFrame, shape: dict) -> DataFrame:
    """One task for each part of a bucket, whose rows fit its memory. Rows that have their part in common meet there without another shuffle."""
    part = (F.col("bucket") * shape["files"] + F.pmod("block", F.lit(shape["files"]))).cast("int")
    return rows.withColumn("part", part).repartitionById(shape["buckets"] * shape["files"], F.col("part"))


def _pages(rows: DataFrame, shape: dict) -> DataFrame:
    """Each page once, of its rows (rank, text, n) the greatest; its tokens are counted where n is null."""
    met = _dealt(rows, shape).groupBy("part", "bucket", "block", *PAGE).agg(F.max(F.struct("rank", "text", "n")).alias("_row")).select("bucket", "block", *PAGE, "_row.*")
    return met.withColumns({"digest": F.xxhash64("page_no", "text"), "n": F.coalesce("n", F.size(search.tokens(F.col("text"))))})


def _write(made: PageIndex, name: str, rows: DataFrame, order: list[str], version: str, buckets: list[int], whole: bool = False) -> DataFrame:
    """A file for each task and bucket, sorted. whole: rows come from the index's own files, each of which is one task. Its versions are entered in made."""
    full = rows.select(*[c.split()[0] for c in TABLES[name].split(", ")], "bucket", F.lit(version).alias("version"))
    with settings(made.spark, RELEASED | (WHOLE_FILES if whole else {})):
        full.sortWithinPartitions("bucket", "version", *order).write.partitionBy("bucket", "version").options(compression="zstd", maxRecordsPerFile=0).mode("append").parquet(f"{made.path}/{name}")
    made.versions[name] = {str(b): version for b in buckets if manifests.exists(made.spark, f"{made.path}/{name}/bucket={b}/version={version}")}
    return made.table(name)


def _write_trigrams(made: PageIndex, stored: DataFrame, version: str, buckets: list[int]) -> None:
    grams = stored.select("block", F.lower(text_of(F.col("text"))).alias("_low")).mapInArrow(_grams, "block int, gram string")
    grams = _dealt(grams.withColumn("bucket", F.floor(F.col("block") / made.shape["blocks"]).cast("int")), made.shape).distinct()
    grams = _write(made, "grams", grams, ["gram", "block"], version, buckets, whole=True)
    _write(made, "counts", grams.groupBy("bucket", "gram").agg(F.count("*").alias("df")).repartition("bucket"), ["gram"], version, buckets)
    made.versions[TRIGRAMS] = {str(b): version for b in buckets}


def with_trigrams(index: PageIndex) -> PageIndex:
    """The index with the trigrams of all its pages: those of buckets that have none are made and published. Where another writer publishes first, they serve this reader alone."""
    now = open_index(index.spark, index.path)
    if now and now.versions["pages"] == index.versions["pages"]:
        index = now
    lacking = [int(b) for b in index.versions["pages"] if b not in index.versions.get(TRIGRAMS, {})]
    if not lacking:
        return index
    made = PageIndex(index.spark, index.path, 0, index.shape, {})
    _write_trigrams(made, index.table("pages", lacking), f"v{index.number + 1}-{uuid.uuid4().hex[:8]}", lacking)
    versions = index.versions | {n: index.versions.get(n, {}) | made.versions[n] for n in ("grams", "counts", TRIGRAMS)}
    try:
        manifests.publish(index.spark, index.path, index.number + 1, {"shape": index.shape, "versions": versions})
    except FileExistsError:
        return PageIndex(index.spark, index.path, index.number, index.shape, versions)
    return PageIndex(index.spark, index.path, index.number + 1, index.shape, versions)


def update(spark: SparkSession, path: str, pages: DataFrame | None, gone: DataFrame | None = None, buckets: int = BUCKETS, blocks: int | None = None, files: int | None = None, trigrams: bool = True) -> PageIndex:
    """Bring the index up to date, or build it where there is none.

    pages (document_id, page_no, text): all pages of the documents that may have changed; those whose pages are as before stay untouched. gone
    (document_id): documents to leave out. Rows without a document are no pages; of repeated page numbers the greatest text
    counts. buckets, blocks (of a bucket) and files (of a bucket and table) count when the index is new; the latter two
    grow with the texts where they are not given. trigrams: whether changed buckets get theirs now, or before the next substring search.
    """
    old = open_index(spark, path)
    given = spark.createDataFrame([], TABLES["pages"]).select(*PAGE, "text") if pages is None else pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_no").cast("long").alias("page_no"), "text").where("document_id is not null")
    shape = old.shape if old else _shape(given, buckets, blocks, files)
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(shape["buckets"])).cast("int")
    old = old or PageIndex(spark, path, 0, shape, {})
    block = (F.col("bucket") * shape["blocks"] + F.pmod(F.xxhash64(*PAGE), F.lit(shape["blocks"]))).cast("int")

    unknown = F.lit(None).cast("int").alias("n")
    given = given.withColumn("bucket", bucket).withColumn("block", block).select("bucket", "block", *PAGE, F.lit(2).alias("rank"), "text", unknown)
    if old.number:
        stood, now = _digests(old.table("pages")), _digests(_pages(given, shape))
        changed = now.join(stood, ["document_id", "n", "digest"], "left_anti").select("document_id")
        if gone is not None:
            changed = changed.unionByName(gone.select(F.col("document_id").cast("string").alias("document_id")).distinct().join(stood, "document_id", "left_semi").join(now, "document_id", "left_anti").select("document_id"))
        with settings(spark, RELEASED):
            moved = written(changed, "moved")
        touched = sorted(r["bucket"] for r in moved.select(bucket.alias("bucket")).distinct().collect())
        if not touched:
            return old
        # No text is joined with moved: a mark for each page that a changed document had outdoes the stored page and gives way to a given one.
        there = old.table("pages", touched).select("bucket", "block", *PAGE, F.lit(0).alias("rank"), "text", "n")
        marks = there.join(moved, "document_id", "left_semi").select("bucket", "block", *PAGE, F.lit(1).alias("rank"), F.lit(None).cast("string").alias("text"), unknown)
        fresh = given.where(F.col("bucket").isin(touched)).unionByName(there).unionByName(marks)
        fresh = _pages(fresh, shape).where("rank <> 1")
    else:
        moved, touched, fresh = None, list(range(shape["buckets"])), _pages(given, shape)
    version = f"v{old.number + 1}-{uuid.uuid4().hex[:8]}"
    made = PageIndex(spark, path, 0, shape, {})

    stored = _write(made, "pages", fresh, ["block", *PAGE], version, touched)
    own, said = search.tokens(F.col("document_id")), search.tokens(F.col("text"))
    each = stored.select("bucket", "block", *PAGE, "n", F.concat(own, said).alias("_tokens"), F.size(own).alias("_own"))
    posted = each.mapInArrow(_posted, "bucket int, block int, " + ", ".join(f"{c} {t}" for c, t in (("document_id", "string"), ("page_no", "long"), ("n", "int"), ("token", "string"), ("positions", "array<int>"))))
    postings = _write(made, "postings", posted, ["token", "block", *PAGE], version, touched, whole=True)
    # Positions ascend, so few rows have one of the id's.
    tf = F.when(F.element_at("positions", 1) >= 0, F.size("positions")).otherwise(F.size(F.filter("positions", lambda p: p >= 0)))
    summed = postings.select("block", "token", tf.alias("tf"), "n").mapInArrow(_summed, TABLES["blocks"].replace("token string, block int", "block int, token string"))
    summed = summed.withColumn("bucket", F.floor(F.col("block") / shape["blocks"]).cast("int"))
    _write(made, "blocks", summed, ["token", "block"], version, touched, whole=True)
    if trigrams:
        _write_trigrams(made, stored, version, touched)

    versions = {n: {b: v for b, v in old.versions.get(n, {}).items() if int(b) not in touched} | made.versions.get(n, {}) for n in [*TABLES, TRIGRAMS]}
    manifests.publish(spark, path, old.number + 1, {"shape": shape, "versions": versions})
    if moved is not None:
        unwrite(moved)
    return PageIndex(spark, path, old.number + 1, shape, versions)


def sync(spark: SparkSession, path: str, pages: DataFrame, **options: int) -> PageIndex:
    """update with all pages there are: documents that pages has no more leave the index."""
    old = open_index(spark, path)
    gone = old.table("pages").select("document_id").distinct().join(pages.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "document_id", "left_anti") if old else None
    return update(spark, path, pages, gone, **options)


def vacuum(index: PageIndex) -> int:
    """Delete the versions that the manifest does not name, once nobody reads them any more; gives how many."""
    n = 0
    for name in TABLES:
        for b in manifests.children(index.spark, f"{index.path}/{name}"):
            if b.startswith("bucket="):
                for v in manifests.children(index.spark, f"{index.path}/{name}/{b}"):
                    if index.versions[name].get(b[7:]) != v.removeprefix("version="):
                        n += manifests.delete(index.spark, f"{index.path}/{name}/{b}/{v}")
    return n


# --- words --------------------------------------------------------------------------------------------------------------
def stated(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose key is in wanted: by a list of keys, where these are few, which prunes files; else by a semi-join."""
    few = [r[0] for r in wanted.select(key).distinct().limit(MOST_STATED + 1).collect()]
    return rows.where(F.col(key).isin(few)) if len(few) <= MOST_STATED else rows.join(wanted.select(key).distinct(), key, "left_semi")


def conjunctions(postings: DataFrame, counts: DataFrame, each: DataFrame) -> DataFrame:
    """(query_id, document_id, page_no) of pages that have all tokens of a query. postings: token, document_id, page_no, each once; counts: token, df; each: query_id, token.

    A query's pages are taken from its rarest token; the others are tested by a join on token and page, which no common token makes hot.
    """
    counted = each.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    lead = counted.groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("_l"), F.count("*").alias("_n")).where("_l.df > 0")
    lead = lead.select("query_id", F.col("_l.token").alias("token"), (F.col("_n") - 1).alias("_n"))
    met = postings.join(lead, "token")
    others = each.join(lead.select("query_id", F.col("token").alias("_lead")), "query_id").where(F.col("token") != F.col("_lead")).select("query_id", "token")
    wanted = met.where("_n > 0").select("query_id", "_n", *PAGE).join(others, "query_id")
    found = wanted.join(postings, ["token", *PAGE]).groupBy("query_id", *PAGE, "_n").agg(F.count("*").alias("_k")).where(F.col("_k") == F.col("_n"))
    return met.where("_n = 0").select("query_id", *PAGE).unionByName(found.select("query_id", *PAGE))


def word_hits(index: PageIndex, queries: DataFrame) -> DataFrame:
    """As search.word_hits, from the postings."""
    each = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("query")))).alias("token"))
    counts = stated(index.table("blocks"), "token", each).groupBy("token").agg(F.sum("df").alias("df"))
    return conjunctions(stated(index.table("postings"), "token", each).select("token", *PAGE), counts, each)


def phrase_hits(postings: DataFrame, phrases: list[tuple[str, list[str]]]) -> DataFrame:
    """(name, document_id, page_no) of pages that have the tokens of a stated phrase one after another, by their positions."""
    rows = [(name, t, at, len(ts)) for name, ts in phrases for at, t in enumerate(ts)]
    asked = postings.sparkSession.createDataFrame(rows, "name string, token string, at int, size int")
    begin = F.transform("positions", lambda p: p - F.col("at"))
    met = postings.join(asked, "token").select("name", *PAGE, "size", F.explode(begin).alias("begin"))
    return met.groupBy("name", *PAGE, "begin", "size").agg(F.count("*").alias("k")).where("k = size").select("name", *PAGE).distinct()


def grammar_hits(index: PageIndex, queries: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """As search.grammar_hits, from the postings: words, beginnings and phrases of all stated queries in one pass over their postings, then each page's list of what it meets."""
    spark = index.spark
    plain = [(n, q) for n, q in queries if search.parse(q) is None]
    parsed = {n: g for n, q in queries if (g := search.parse(q)) is not None}
    terms = sorted({t for groups in parsed.values() for g in groups for t in g["all"] + g["none"]})
    folded = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for _, t in terms] or [("",)], "t string").select("t", search.tokens(F.col("t")).alias("f")).distinct().collect()}
    atom = {(kind, t): f"{kind}:{' '.join(folded[t])}" for kind, t in terms if folded[t]}
    postings, tags, exact, long = index.table("postings"), [], set(), {}
    for (kind, t), name in atom.items():
        words = folded[t]
        if kind == "prefix":
            tags.append(F.when(F.col("token").startswith(words[0]), F.lit(name)))
        elif len(words) == 1:
            exact.add(words[0])
            tags.append(F.when(F.col("token") == words[0], F.lit(name)))
        else:
            long[name] = words
    hits = spark.createDataFrame([], "query_id string, document_id string, page_no long")
    if not atom:
        return hits, plain
    begins = [F.col("token").startswith(folded[t][0]) for kind, t in atom if kind == "prefix"]
    any_of = F.col("token").isin(sorted(exact)) if exact else F.lit(False)
    for b in begins:
        any_of = any_of | b
    met = [postings.where(any_of).select(*PAGE, F.explode(F.array_compact(F.array(*tags))).alias("name"))] if tags else []
    if long:
        met.append(phrase_hits(postings.where(F.col("token").isin(sorted({w for ws in long.values() for w in ws}))), list(long.items())).select(*PAGE, "name"))
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    has = every.groupBy(*PAGE).agg(F.collect_set("name").alias("_has"))
    found = []
    for name, groups in parsed.items():
        some = F.lit(False)
        for g in groups:
            one = F.lit(True)
            for part in g["all"]:
                one = one & (F.array_contains("_has", atom[part]) if part in atom else F.lit(False))
            for part in g["none"]:
                one = one & (~F.array_contains("_has", atom[part]) if part in atom else F.lit(True))
            some = some | one
        found.append(F.when(some, F.lit(name)))
    return has.select(F.explode(F.array_compact(F.array(*found))).alias("query_id"), *PAGE), plain


# --- substrings ---------------------------------------------------------------------------------------------------------
def _chosen_grams(index: PageIndex, terms: list[str]) -> dict[str, list[str]]:
    """For each stated term of three letters or more its rarest trigrams; none where the index lacks one of them, so that no page can have the term."""
    spark = index.spark
    low = {r["t"]: r["l"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.lower("t").alias("l")).collect()}
    of = {t: sorted({x[i : i + 3] for i in range(len(x) - 2)}) for t, x in low.items()}
    wanted = sorted({g for gs in of.values() for g in gs})
    df = {r["gram"]: r["df"] for r in index.table("counts").where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("df").alias("df")).collect()}
    return {t: sorted(gs, key=lambda g: (df[g], g))[:RAREST] if all(g in df for g in gs) else [] for t, gs in of.items()}


def term_hits(index: PageIndex, terms: list[tuple[str, str]]) -> DataFrame:
    """(query_id, document_id, page_no, text) of pages that hold the stated term, case apart: blocks with its rarest trigrams, then the texts themselves. Terms of one or two letters are searched in all texts."""
    spark, asked = index.spark, [(n, t.lower()) for n, t in terms if t]
    out = spark.createDataFrame([], "query_id string, document_id string, page_no long, text string")
    low = F.lower(text_of(F.col("text")))
    long, short = [x for x in asked if len(x[1]) >= 3], [x for x in asked if len(x[1]) < 3]
    if long:
        index = with_trigrams(index)
        chosen = _chosen_grams(index, sorted({t for _, t in long}))
        rows = [(n, t, g, len(chosen[t])) for n, t in dict.fromkeys(long) for g in chosen[t]]
        if rows:
            grams = index.table("grams").where(F.col("gram").isin(sorted({r[2] for r in rows})))
            met = grams.join(F.broadcast(spark.createDataFrame(rows, "query_id string, term string, gram string, k int")), "gram")
            met = met.groupBy("query_id", "term", "k", "block").agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("k")).select("query_id", "term", "block")
            read = stated(index.table("pages"), "block", met).select("block", *PAGE, "text", low.alias("_low"))
            out = out.unionByName(read.join(F.broadcast(met), "block").where(F.col("_low").contains(F.col("term"))).select("query_id", *PAGE, "text"))
    if short:
        tags = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(n)) for n, t in dict.fromkeys(short)]))
        out = out.unionByName(index.table("pages").select(F.explode(tags).alias("query_id"), *PAGE, "text"))
    return out


def substring_hits(index: PageIndex, queries: list[tuple[str, str]], relaxed: bool = False) -> DataFrame:
    """As search.substring_hits, from the trigrams. Parts are searched only for queries that no page has as a whole, or where relaxed."""
    whole = term_hits(index, [(n, q.strip()) for n, q in queries])
    answered = set() if relaxed else {r[0] for r in whole.select("query_id").distinct().collect()}
    hits, parts = whole, [(n, t) for n, q in queries if n not in answered for t in search.terms_of(q)[1:17] if len(t) >= 2]
    if parts:
        hits = whole.unionByName(term_hits(index, parts).dropDuplicates(["query_id", *PAGE])).dropDuplicates(["query_id", *PAGE])
    score = None
    for name, query in queries:
        score = (F if score is None else score).when(F.col("query_id") == name, search.substring_score(F.col("_body"), query))
    body = F.regexp_replace(F.lower(text_of(F.col("text"))), r"\s+", "")
    return hits.select("query_id", *PAGE, body.alias("_body")).select("query_id", *PAGE, score.alias("score"))


# --- BM25 ---------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Ranking:
    """wanted: query_id, token, idf; bounds: query_id, block, bound; live: those that have to be scored; scored: query_id, document_id, page_no, score."""

    wanted: DataFrame
    bounds: DataFrame
    live: DataFrame
    scored: DataFrame


def bm25(index: PageIndex, queries: DataFrame, limit: int, places: int = 6) -> DataFrame:
    """(query_id, document_id, page_no, score, rank): the first `limit` pages of search.bm25, reading only blocks that can hold one of them."""
    return search.top(ranking(index, queries, limit, places).scored, limit, [F.desc("score"), *map(F.col, PAGE)])


def ranking(index: PageIndex, queries: DataFrame, limit: int, places: int = 6) -> Ranking:
    """Bounds of all blocks from their largest counts and shortest pages; the SEEDS blocks of the highest bounds give each query a score that the last place has at least; blocks whose bound is below it are left out before postings are joined."""
    stats = index.table("pages").agg(F.count("*").alias("_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    each = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("query")))).alias("token"))
    blocks = stated(index.table("blocks"), "token", each).where("text_df > 0")
    df = blocks.groupBy("token").agg(F.sum("text_df").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # Totals are one row, which rides along with every token.
    wanted = each.join(df, "token").crossJoin(F.broadcast(stats)).select("query_id", "token", idf.alias("idf"), (F.col("_pages") / F.greatest(F.col("_total"), F.lit(1))).alias("_share"))

    def weight(tf: Column, n: Column) -> Column:
        return F.col("idf") * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * n * F.col("_share")))

    bounds = blocks.join(wanted, "token").groupBy("query_id", "block").agg(F.sum(weight(F.col("most_tf"), F.col("least_n"))).alias("bound"))
    tf = F.size(F.filter("positions", lambda p: p >= 0))
    postings = stated(index.table("postings"), "token", each).select("token", "block", *PAGE, "n", tf.alias("tf")).where("tf > 0")

    def scores(some: DataFrame) -> DataFrame:
        return postings.join(wanted.join(some, "query_id"), ["token", "block"]).groupBy("query_id", *PAGE).agg(F.round(F.sum(weight(F.col("tf"), F.col("n"))), places).alias("score"))

    seeds = search.top(bounds, SEEDS, [F.desc("bound"), F.col("block")]).select("query_id", "block")
    last = search.top(scores(seeds), limit, [F.desc("score"), *map(F.col, PAGE)]).where(F.col("rank") == limit).select("query_id", F.col("score").alias("_last"))
    # Rounding moves a score by less than 10^-places.
    live = bounds.join(last, "query_id", "left").where(F.col("_last").isNull() | (F.col("bound") + 10.0**-places >= F.col("_last"))).select("query_id", "block")
    return Ranking(wanted, bounds, live, scores(live))


def kept(spark: SparkSession, name: str, source: DataFrame, pages: DataFrame, folder: str, trigrams: bool = True) -> PageIndex:
    """The index of `pages`, made from the files of `source`, in a shared folder: used as it is while those files are as they were, else brought up to date."""
    path, now = f"{folder}/page-index-{name}", manifests.signature(spark, source.inputFiles())
    number, seen = manifests.latest(spark, f"{path}/source")
    found = open_index(spark, path)
    if found and seen and seen["files"] == now:
        return found
    found = sync(spark, path, pages, trigrams=trigrams)
    manifests.publish(spark, f"{path}/source", number + 1, {"files": now})
    return found
