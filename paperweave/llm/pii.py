r"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates are the matches of a strict pattern for each kind and of a looser one. Three labelers vote on each (1 yes, 0 no,
-1 abstains): the regex labeler (is a strict match valid?), the gazetteer labeler (known top-level domains, dialling codes,
card issuers, address ranges) and the context labeler (telling words just before). Expectation-maximisation over the table of
vote patterns (at most 27 rows for each kind) estimates how reliable each labeler is, and its posteriors train a logistic
span classifier on that table; both run on these few numbers, and the classifier is applied as a column expression.

Valid strict matches always stay. A looser candidate is added where the classifier gives it at least THRESHOLD and it
overlaps no span already there.

Offsets come from split() and regexp_extract_all() with one pattern: both walk through the same matches, and the lengths are
summed up by doubling steps, so n matches in one text cost n log n. Parts of a text are cut from chunks of CHUNK letters, since
substr() counts from the start of a string. The patterns are written so that their matches are the leftmost ones at a cost
linear in the text, however long a run of letters or digits is: possessive repeats, and a look-behind with \G in place of
starts within a run that already failed. Of card numbers only runs of 14 to 19 digits are taken, as no other can be valid.

Defined cases: null text counts as empty and has no spans (redact leaves it null); very long texts and texts of very many
matches are treated whole; spans that start together are sorted by kind, then end; repeated rows are treated alike; null ids
stay null; an empty table gives an empty result; other columns are ignored, and returned by redact, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, row_columns, whole_row

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT = 32
CHUNK = 256

# The strict patterns of the contract in linear form.
_LOCAL = r"[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]{2,24}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_-])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_-])",
    "phone": r"(?<![0-9+.()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.()-])",
}
#: Nothing of a kind can be found without it; a cheap test before the patterns.
NEEDS = {
    "email": ("text like '%@%'", "text like '%at)%' or text like '%at]%'"),
    "ip": ("text rlike '[0-9][.][0-9]'", "text like '%:%'"),
    "card": ("text rlike '[0-9]'", "text rlike '[0-9][./_][0-9]'"),
    "phone": ("text like '%+%'", "text rlike '[0-9]'"),
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_DOUBLE = "cast(substr(%s, i, 1) as int) * 2" % _DIGITS
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case when (length({_DIGITS}) - i) % 2 = 0 then cast(substr({_DIGITS}, i, 1) as int) when {_DOUBLE} > 9 then {_DOUBLE} - 9 else {_DOUBLE} end) % 10 = 0"
VALID = {
    "email": "true",
    "ip": rf"x.t rlike r'^{_PART}(?:[.]{_PART}){{3}}$'",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
GAZETTEER = {
    "email": "lower(x.t) rlike '(com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|jp|cn|in|br)$'",
    "ip": "not x.t rlike '^(0|22[4-9]|2[3-5][0-9])[.]'",
    "card": f"{_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[4-7]|6011|65|62|30)'",
    "phone": f"{_DIGITS} rlike '^(1[2-9]|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])' or not x.t like '+%' and {_DIGITS} rlike '^[2-9][0-9]{{2}}[2-9]'",
}
CONTEXT_YES = {
    "email": "(?i)(mail|contact|kontakt|contacto|courriel|correo|write to|reach)",
    "ip": r"(?i)\b(ip|host|server|address|adresse|dirección|client|from)\b",
    "card": "(?i)(card|visa|amex|karte|tarjeta|carte|credit|kredit|crédit)",
    "phone": "(?i)(phone|tel|call|fon|mobil|fax|whatsapp|llam|appel|ruf)",
}
CONTEXT_NO = r"(?i)\b(version|isbn|issn|order|invoice|sku|serial|section|chapter|page|total|ratio|hash|commit|build)\b"

_SPAN = "array<struct<s:int,e:int,t:string,k:int,strict:boolean,v1:int,v2:int,v3:int,p:double>>"


def _scan(values: str, step: str, padding: str, back: bool = False) -> str:
    """Running sums, maxima or the like of an array by doubling steps; from the end where `back`."""
    moved = f"concat(slice(a, shiftleft(1, i) + 1, size(a) - shiftleft(1, i)), array_repeat({padding}, shiftleft(1, i)))" if back else f"concat(array_repeat({padding}, shiftleft(1, i)), slice(a, 1, size(a) - shiftleft(1, i)))"
    return f"aggregate(sequence(0, 30), {values}, (a, i) -> if(shiftleft(1, i) >= size(a), a, zip_with(a, {moved}, (x, y) -> {step})))"


def _cut(a: str, b: str) -> str:
    """Letters a to b (from 0, end exclusive) of a text, taken from its chunks."""
    first, last = f"cast(floor(({a}) / {CHUNK}) as int)", f"cast(floor((({b}) - 1) / {CHUNK}) as int)"
    one = f"substr(get(_chunks, {first}), ({a}) % {CHUNK} + 1, ({b}) - ({a}))"
    more = f"concat(substr(get(_chunks, {first}), ({a}) % {CHUNK} + 1), array_join(slice(_chunks, {first} + 2, {last} - {first} - 1), ''), substr(get(_chunks, {last}), 1, (({b}) - 1) % {CHUNK} + 1))"
    return f"if(({b}) <= ({a}), '', if({first} = {last}, {one}, {more}))"


def _found(kind: str, strict: bool) -> Column:
    """Every match with its offsets and votes."""
    m, ends = f"_m_{kind}{int(strict)}", f"_e_{kind}{int(strict)}"
    spans = f"transform(arrays_zip({m}, {ends}), x -> named_struct('s', x.{ends} - length(x.{m}), 'e', x.{ends}, 't', x.{m}))"
    before = _cut(f"greatest(0, x.s - {CONTEXT})", "x.s")
    v1 = f"if({VALID[kind]}, 1, 0)" if strict else "-1"
    v3 = f"case when {before} rlike r'{CONTEXT_YES[kind]}' then 1 when {before} rlike r'{CONTEXT_NO}' then 0 else -1 end"
    voted = f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'k', {KINDS.index(kind)}, 'strict', {'true' if strict else 'false'}, 'v1', {v1}, 'v2', if({GAZETTEER[kind]}, 1, 0), 'v3', {v3}, 'p', cast(0 as double)))"
    return F.expr(f"cast(if(size({m}) > 0, {voted}, array()) as {_SPAN})")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (all columns of docs), `text` (never null), `_chunks` (null without candidates) and `_found`, all candidates of a row."""
    df = docs.select(whole_row(docs).alias("row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    every = [(k, strict) for k in KINDS for strict in (True, False)]
    matches, ends, none = {}, {}, F.array().cast("array<string>")
    for kind, strict in every:
        pattern, at = (STRICT if strict else LOOSE)[kind], f"{kind}{int(strict)}"
        matches[f"_m_{at}"] = F.when(F.expr(NEEDS[kind][not strict]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        lengths = f"zip_with(_m_{at}, slice(split(text, r'{pattern}', -1), 1, size(_m_{at})), (m, p) -> length(m) + length(p))"
        ends[f"_e_{at}"] = F.expr(f"if(size(_m_{at}) > 0, {_scan(lengths, 'x + y', '0')}, cast(array() as array<int>))")
    some = F.expr(" or ".join(f"size({m}) > 0" for m in matches))
    df = df.withColumns(matches).withColumns(ends | {"_chunks": F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))})
    return df.withColumn("_found", F.concat(*[_found(k, s) for k, s in every])).select("row", "text", "_chunks", "_found")


def vote_table(found: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(kind, three votes, how many) over all candidates of all rows; at most 108 rows."""
    each = found.where("size(_found) > 0").select(F.explode("_found").alias("c")).groupBy("c.k", "c.v1", "c.v2", "c.v3").count()
    return sorted(tuple(r) for r in each.collect())


def estimate(table: list[tuple[int, int, int, int, int]], rounds: int = 60) -> dict[tuple[int, int, int, int], float]:
    """Posterior of being personal data for each vote pattern, by expectation-maximisation with one reliability for each labeler, kind and class."""
    posterior: dict = {}
    for kind in {r[0] for r in table}:
        rows = [(r[1:4], r[4]) for r in table if r[0] == kind]
        prior, yes, no = 0.5, [0.8] * 3, [0.2] * 3
        for _ in range(rounds):
            p = {}
            for votes, _n in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for v, y, z in zip(votes, yes, no, strict=True):
                    if v >= 0:
                        a += math.log(y if v else 1 - y)
                        b += math.log(z if v else 1 - z)
                p[votes] = 1 / (1 + math.exp(min(50, b - a)))
            total = sum(n for _, n in rows)
            prior = (sum(p[v] * n for v, n in rows) + 1) / (total + 2)
            for i in range(3):
                cast = [(v, n) for v, n in rows if v[i] >= 0]
                # The counts added for smoothing hold a labeler to being better than chance where it rarely votes.
                yes[i] = (sum(p[v] * n for v, n in cast if v[i]) + 4) / (sum(p[v] * n for v, n in cast) + 5)
                no[i] = (sum((1 - p[v]) * n for v, n in cast if v[i]) + 1) / (sum((1 - p[v]) * n for v, n in cast) + 5)
        posterior |= {(kind, *v): q for v, q in p.items()}
    return posterior


def _features(kind: int, votes: tuple[int, int, int]) -> list[float]:
    return [float(kind == k) for k in range(len(KINDS))] + [float(v == w) for v in votes for w in (0, 1)]


def train(table: list[tuple[int, int, int, int, int]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, each vote pattern weighted by the logarithm of its count."""
    posterior = estimate(table)
    rows = [(_features(r[0], r[1:4]), posterior[r[:4]], math.log1p(r[4])) for r in table]
    weights = [0.0] * (len(KINDS) + 6)
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(steps):
        slope = [decay * w for w in weights]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50, min(50, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for i, v in enumerate(x):
                slope[i] += (p - y) * v * n / total
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _probability(weights: list[float]) -> str:
    kind = "element_at(array(" + ", ".join(f"{w!r}D" for w in weights[: len(KINDS)]) + "), c.k + 1)"
    votes = " + ".join(f"case c.v{i + 1} when 0 then {weights[4 + 2 * i]!r}D when 1 then {weights[5 + 2 * i]!r}D else 0D end" for i in range(3))
    return f"1D / (1D + exp(-({kind} + {votes})))"


def _spans(found: DataFrame, weights: list[float] | None) -> DataFrame:
    """candidates() with `base` and `spans` in place of `_found`."""
    if weights is None:
        weights = train(vote_table(found))
    short = "c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)"
    likely = f"filter(_found, c -> not c.strict and {_probability(weights)} >= {THRESHOLD}D)"
    out = found.withColumns({"base": F.expr(f"sort_array(transform(filter(_found, c -> c.strict and c.v1 = 1), {short}))"), "_likely": F.expr(f"if(exists(_found, c -> not c.strict), {likely}, filter(_found, c -> false))")})
    # In one order by start, strict spans first: the furthest end of strict spans up to a candidate, and the nearest start of one after it.
    mixed = "sort_array(concat(transform(base, c -> named_struct('s', c.s, 'o', 0, 'k', c.k, 'e', c.e)), transform(_likely, c -> named_struct('s', c.s, 'o', 1, 'k', c.k, 'e', c.e))))"
    out = out.withColumn("_mixed", F.expr(f"if(size(_likely) > 0, {mixed}, slice({mixed}, 1, 0))"))
    end = _scan("transform(_mixed, c -> if(c.o = 0, c.e, 0))", "greatest(x, y)", "0")
    start = _scan("transform(_mixed, c -> if(c.o = 0, c.s, 2147483647))", "least(x, y)", "2147483647", back=True)
    out = out.withColumns({"_end": F.expr(end), "_start": F.expr(start)})
    added = f"transform(filter(arrays_zip(_mixed, _end, _start), x -> x._mixed.o = 1 and x._end <= x._mixed.s and x._start >= x._mixed.e), x -> named_struct('s', x._mixed.s, 'k', x._mixed.k, 'e', x._mixed.e))"
    return out.withColumn("spans", F.expr(f"if(size(_likely) > 0, sort_array(concat(base, {added})), base)")).select("row", "text", "_chunks", "base", "spans")


def find(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, base, spans): `text` never null, `base` the valid strict spans, `spans` those and the added ones, each sorted by start and kind: arrays of (s, k, e)."""
    return _spans(candidates(docs, text_col), weights).select(F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), "text", "base", "spans")


def as_text(column: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, c -> concat(element_at({names}, c.k + 1), ':', c.s, ':', c.e)), ',')")


def count_of(kind: str) -> Column:
    return F.expr(f"cast(size(filter(base, c -> c.k = {KINDS.index(kind)})) as long)")


def redact(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """docs with every span of the text replaced by its kind, as in <EMAIL>; of spans that overlap the first gives the name. A null text stays null."""
    marked = _spans(candidates(docs, text_col), weights)
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    reach = _scan("transform(spans, c -> c.e)", "greatest(x, y)", "0")
    marked = marked.withColumn("_reach", F.expr(f"if(size(spans) > 0, {reach}, cast(array() as array<int>))"))
    pieces = f"transform(arrays_zip(spans, _from), x -> if(x.spans.s < x._from, '', concat({_cut('x._from', 'x.spans.s')}, element_at({names}, x.spans.k + 1))))"
    marked = marked.withColumn("_from", F.expr("if(size(spans) > 0, concat(array(0), slice(_reach, 1, size(spans) - 1)), _reach)"))
    tail = _cut("element_at(_reach, -1)", "length(text)")
    before = F.col(f"row.{quoted(text_col)}")
    clean = F.when(before.isNull(), before).when(F.size("spans") == 0, before).otherwise(F.expr(f"concat(array_join({pieces}, ''), {tail})"))
    out = marked.select("row", clean.alias("clean"))
    return out.select(*[F.col("clean").alias(c) if c == text_col else column for c, column in zip(docs.columns, row_columns(docs.columns), strict=True)])
