"""Page search. Pages are rows (document_id, page_no, text); queries are rows (query_id, query) or a stated list.

These searches read all pages; index.py has the same ones over a kept index. Word search joins the asked tokens of pages with
queries. Substring search tests a stated list of queries against each page where it is read. Both order their results totally:
branch, score, document, page.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase, text_of

#: Words that make a longer query worth an exact phrase filter. Fixed values.
PHRASE_WORDS = ("a", "an", "and", "for", "from", "in", "of", "or", "the", "to", "with")
SNIPPET, SNIPPET_BEFORE = 800, 160
MOST_COUNT = 20

_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii() and unicodedata.normalize("NFD", chr(c)) != chr(c)]
_BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(c: Column) -> Column:
    """Lower case without accents on Latin letters."""
    low = F.lower(text_of(c))
    return F.when(low.rlike("[^\\x00-\\x7f]"), F.translate(low, "".join(_ACCENTED), _BARE.lower())).otherwise(low)


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_hits(pages: DataFrame, queries: DataFrame, match_ids: bool = True) -> DataFrame:
    """(query_id, document_id, page_no) of pages that have every token of the query, in the text or the document's id.

    Of a page's tokens only asked ones become rows, and no row carries a list. With up to MOST_STATED asked tokens these
    are picked where the page is read, and each task counts a page's tokens by query before the shuffle; with more, a query's
    pages are taken from its rarest token (index.conjunctions). For many searches over the same pages, keep an index.
    """
    from . import index

    each = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    body = F.concat_ws(" ", F.col("document_id"), F.col("text")) if match_ids else F.col("text")
    few = each.limit(index.MOST_STATED + 1).collect()
    if len(few) > index.MOST_STATED:
        postings = pages.select("document_id", "page_no", F.explode(F.array_distinct(tokens(body))).alias("token")).join(each.select("token").distinct(), "token", "left_semi")
        return index.conjunctions(postings, postings.groupBy("token").agg(F.count("*").alias("df")), each)
    asked = F.array(*[F.lit(t) for t in sorted({r["token"] for r in few})]) if few else F.array().cast("array<string>")
    size = each.groupBy("query_id").agg(F.count("*").alias("_n"))
    met = pages.select("document_id", "page_no", F.explode(F.array_intersect(tokens(body), asked)).alias("token")).join(each, "token")
    counted = met.groupBy("query_id", "document_id", "page_no").agg(F.count("*").alias("_k"))
    return counted.join(size, "query_id").where("_k = _n").select("query_id", "document_id", "page_no")


def phrase_filter(hits: DataFrame, pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Of hits for queries of three or more words with a small word among them, those whose page has the whole phrase; all of a query's hits where none has it."""
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0))
    strict = (F.size(words) >= 3) & F.arrays_overlap(words, F.array(*map(F.lit, PHRASE_WORDS)))
    wide = hits.join(queries.select("query_id", phrase(F.col("query")).alias("_phrase"), strict.alias("_strict")), "query_id")
    wide = wide.join(pages.select("document_id", "page_no", phrase(F.col("text")).alias("_body")), ["document_id", "page_no"])
    marked = wide.select(*hits.columns, "_strict", F.col("_body").contains(F.col("_phrase")).alias("_has"))
    some = marked.groupBy("query_id").agg(F.bool_or("_has").alias("_some"))
    return marked.join(some, "query_id").where(~F.col("_strict") | F.col("_has") | ~F.col("_some")).select(*hits.columns)


def terms_of(query: str) -> list[str]:
    """The whole query and its parts, each once, in order."""
    text = (query or "").strip()
    return list(dict.fromkeys(x for x in [text, *text.split()] if x))


def occurrences(body: Column, term: str) -> Column:
    return ((F.length(body) - F.length(F.replace(body, F.lit(term)))) / len(term)).cast("int")


def substring_score(body: Column, query: str) -> Column:
    """100 for each term found and its number of places (20 at most). body: a text through compact()."""
    counts = F.array(*[F.least(F.lit(MOST_COUNT), occurrences(body, "".join(t.lower().split()))) for t in terms_of(query)])
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n + F.when(n > 0, 100).otherwise(0))


def substring_hits(pages: DataFrame, queries: list[tuple[str, str]], relaxed: bool = False) -> DataFrame:
    """(query_id, document_id, page_no, score) of pages with the whole query; with parts of it where no page has the whole, or where relaxed."""
    found, score = [], None
    for name, query in queries:
        parts = [t for t in terms_of(query)[1:17] if len(t) >= 2]
        whole = F.col("_low").contains(query.strip().lower())
        part = F.lit(False)
        for t in parts:
            part = part | F.col("_low").contains(t.lower())
        found.append(F.when(whole | part, F.struct(F.lit(name).alias("query_id"), whole.alias("whole"))))
        score = (F if score is None else score).when(F.col("query_id") == name, substring_score(F.col("_body"), query))
    # Each page is lowered once, and white space is stripped from hits alone.
    low = pages.select("document_id", "page_no", F.lower(text_of(F.col("text"))).alias("_low"))
    hits = low.select("document_id", "page_no", "_low", F.explode(F.array_compact(F.array(*found))).alias("h"))
    hits = hits.select("h.query_id", "document_id", "page_no", "h.whole", F.regexp_replace("_low", r"\s+", "").alias("_body"))
    hits = hits.select("query_id", "document_id", "page_no", "whole", score.alias("score"))
    if relaxed:
        return hits.drop("whole")
    some = hits.where("whole").select("query_id").distinct().withColumn("_some", F.lit(True))
    return hits.join(some, "query_id", "left").where(F.col("whole") | F.col("_some").isNull()).select("query_id", "document_id", "page_no", "score")


def top(hits: DataFrame, limit: int, by: list[Column], within: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """The first `limit` rows of each group, with their rank. Spark cuts each task's rows to the limit before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= limit)


def hybrid_hits(pages: DataFrame, queries: list[tuple[str, str]], queries_df: DataFrame, kept=None) -> DataFrame:
    """(query_id, document_id, page_no, branch, score): word hits first, then substring hits of pages not yet there. kept: an index of the pages, to search in its stead.

    A compact CJK query asks the substrings first; a query of 4 to 24 words adds pages with parts of it; any other query asks
    the substrings only where no page has all its words.
    """
    is_cjk = [q for q in queries if not any(c.isspace() for c in q[1].strip()) and len(q[1].strip()) <= 24 and any("㐀" <= c <= "鿿" for c in q[1])]
    is_long = [q for q in queries if 4 <= len([p for p in q[1].split() if len(p) >= 2]) <= 24 and len(q[1]) <= 400]
    from . import index

    words, parts = (index.word_hits, index.substring_hits) if kept else (word_hits, substring_hits)
    pages = kept or pages
    word = words(pages, queries_df).withColumn("score", F.lit(None).cast("int"))
    found = [word.withColumn("branch", F.when(F.col("query_id").isin([n for n, _ in is_cjk]), 1).otherwise(0))]
    always = is_cjk + is_long
    for group, loose in ((is_cjk, False), (is_long, True)):
        if group:
            found.append(parts(pages, group, loose).withColumn("branch", F.lit(0 if group is is_cjk else 1)))
    rest = [q for q in queries if q not in always]
    if rest:
        answered = word.select("query_id").distinct()
        found.append(parts(pages, rest).join(answered, "query_id", "left_anti").withColumn("branch", F.lit(1)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "document_id", "page_no").agg(F.min("branch").alias("branch"), F.max("score").alias("score"))


def snippet(text: Column, terms: list[str]) -> Column:
    """At most 800 characters, from 160 before the first term on; shorter texts whole."""
    body = text_of(text)
    places = F.filter(F.array(*[F.locate(t.lower(), F.lower(body)) for t in terms if t]), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - SNIPPET_BEFORE)
    return F.when(F.length(body) <= SNIPPET, body).otherwise(F.substring(body, start, F.lit(SNIPPET)))


def excerpt(text: Column, terms: list[str], longest: int) -> Column:
    """`longest` characters around the first term found (its longest word, where the term itself is not there), with ... where cut."""
    body, low = text_of(text), F.lower(text_of(text))
    places = []
    for term in terms:
        words = sorted({w for w in "".join(c if c.isalnum() or c == "_" else " " for c in term.lower()).split() if len(w) >= 3}, key=lambda w: (-len(w), w))
        places += [F.nullif(F.locate(t, low), F.lit(0)) for t in [term.strip().lower(), *words] if t]
    hit = F.coalesce(*places, F.lit(0))
    end = F.least(F.length(body), F.greatest(F.lit(0), hit - 1 - longest // 3) + longest)
    start = F.greatest(F.lit(0), end - longest)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(body, start + 1, F.lit(longest)), F.when(end < F.length(body), "...").otherwise(""))
    return F.when(F.length(body) <= longest, body).when(hit == 0, F.substring(body, 1, longest)).otherwise(cut)


# --- the query language ------------------------------------------------------------------------------------------------
_PART = re.compile(r'"([^"]*)"|(\S+)')


def parse(query: str) -> list[dict] | None:
    """Groups joined by OR, of which a page has to meet one: words, beginnings of words (word*), phrases in quotes, and what follows NOT must be missing. None where the text is no query of this language; it is then searched as a substring."""
    if query.count('"') % 2 or not query.strip():
        return None
    groups: list[dict] = [{"all": [], "none": []}]
    side, open_ = "all", True
    for quoted, word in _PART.findall(query):
        if word == "OR":
            if open_:
                return None
            groups.append({"all": [], "none": []})
            open_ = True
        elif word == "NOT":
            if open_ or side == "none":
                return None
            side = "none"
        elif word == "AND":
            if open_:
                return None
        else:
            if word and not re.fullmatch(r"\w+\*?", word):
                return None
            groups[-1][side].append(("phrase", quoted) if quoted else ("prefix", word[:-1]) if word.endswith("*") else ("word", word))
            side, open_ = "all", False
    return None if open_ or side == "none" else groups


def _meets(kind: str, term: str) -> Column:
    folded = tokens(F.lit(term))
    if kind == "prefix":
        return F.exists("_has", lambda t: t.startswith(F.coalesce(F.get(folded, F.lit(0)), F.lit(" "))))
    body = F.concat(F.lit(" "), F.array_join("_has", " "), F.lit(" "))
    return body.contains(F.concat(F.lit(" "), F.array_join(folded, " "), F.lit(" ")))


def grammar_hits(pages: DataFrame, queries: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(query_id, document_id, page_no) of pages that meet a stated query, tested where the page is read; and the queries that are none of the language."""
    plain, found = [], []
    for name, query in queries:
        groups = parse(query)
        if groups is None:
            plain.append((name, query))
            continue
        some = F.lit(False)
        for g in groups:
            one = F.lit(True)
            for kind, term in g["all"]:
                one = one & _meets(kind, term)
            for kind, term in g["none"]:
                one = one & ~_meets(kind, term)
            some = some | one
        found.append(F.when(some, F.lit(name)))
    body = F.concat_ws(" ", F.col("document_id"), F.col("text"))
    rows = pages.select("document_id", "page_no", tokens(body).alias("_has"))
    names = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return rows.select(F.explode(names).alias("query_id"), "document_id", "page_no"), plain


# --- what an index is made of ----------------------------------------------------------------------------------------------------------
def trigrams(c: Column) -> Column:
    """Every three letters in a row, each once; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


K1, B = 1.2, 0.75


def bm25(pages: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """(query_id, document_id, page_no, score): pages with any word of the query by BM25, rounded. Counts are over all pages."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    listed = pages.select("document_id", "page_no", tokens(F.col("text")).alias("_has")).withColumn("n", F.size("_has"))
    n_pages, total = listed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = listed.select("document_id", "page_no", "n", F.explode("_has").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    tf = each.groupBy("token", "document_id", "page_no", "n").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.ln((n_pages - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") * n_pages / max(1, total)))
    scored = tf.join(df.select("token", idf.alias("idf")), "token").join(wanted, "token")
    return scored.groupBy("query_id", "document_id", "page_no").agg(F.round(F.sum(weight), places).alias("score"))
