"""Sets of cited calculations: variables are bound to evidence texts or to earlier results, expressions evaluated exactly, statuses rolled up.

calculations: set_id, calculation_id, expression, expected (text or null), absolute_tolerance, relative_tolerance (text or null),
expected_precision (int or null), checks array<string> such as same_unit, optionally required_metadata array<string> of FIELDS,
and variables, an array of VARIABLE. evidence: evidence_id, text. Citations are joined with their texts; a set, which is small by
contract, is then solved as a whole where its rows meet, so that its layers need no further jobs or joins.

Defined cases: a set of more than MOST_CALCULATIONS, or with a null, blank or repeated id, is invalid as a whole; a calculation
with more than MOST_VARIABLES variables, a null, blank or repeated name, an expected_precision outside 0 to 12 or a null set_id is
invalid; none of them hinders another. Of several texts of one evidence id the least counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Context, Decimal, setcontext
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import exact
from ..session import written
from .review import roll_up

VARIABLE = "struct<name:string,value:string,scale:string,unit:string,period:string,scope:string,currency:string,evidence_id:string,source_type:string,calculation_id:string,source_format:string,relation:string>"
FIELDS = ("unit", "period", "scope", "currency")
USABLE = ("verified", "calculated")
MOST_LAYERS = 30
MOST_CALCULATIONS, MOST_VARIABLES, MOST_DIGITS = 30, 40, 12
_ONE = Decimal(1)
RESULTS = ("calculated", "difference", "arithmetic_status", "status", "assumption_based", "error")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _kind(v: Column) -> Column:
    return F.lower(F.coalesce(v["source_type"], F.lit("evidence")))


def failing(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """The (set_id, calculation_id) with a citation of a text that is not there or, as evidence, does not state the value. citations: set_id, calculation_id, v with an evidence id that is not blank."""
    texts = evidence.groupBy("evidence_id").agg(F.min("text").alias("_text"))
    texts = texts.select("evidence_id", "_text", exact.number_tokens(exact.nfkc(F.col("_text"))).alias("_tokens"))
    wide = citations.join(texts, F.col("v.evidence_id") == F.col("evidence_id"), "left")
    value = F.regexp_replace(F.col("v.value"), ",", "").try_cast("decimal(38,9)")
    found = exact.source_matches(F.col("_tokens"), value, F.coalesce("v.source_format", F.lit("number")), F.coalesce("v.relation", F.lit("equal")))
    lost = F.col("_text").isNull() | ((_kind(F.col("v")) == "evidence") & ~F.coalesce(found, F.lit(False)))
    return wide.where(lost).select("set_id", "calculation_id")


def described(calculations: DataFrame) -> DataFrame:
    """One row for each calculation with `problem` (why it is invalid by itself, else null), what its variables say taken together, and their fields as arrays."""
    if "required_metadata" not in calculations.columns:
        calculations = calculations.withColumn("required_metadata", F.array().cast("array<string>"))
    blank = lambda c: F.trim(_text(c)) == ""
    every = F.coalesce("variables", F.array().cast(f"array<{VARIABLE}>"))
    names = every["name"]
    problem = (
        F.when(F.size(every) > MOST_VARIABLES, f"more than {MOST_VARIABLES} variables").when(F.exists(names, blank) | (F.size(F.array_distinct(names)) < F.size(names)), "a variable name is blank or repeated")
        .when(~F.col("expected_precision").between(0, MOST_DIGITS), f"expected_precision is not between 0 and {MOST_DIGITS}")
    )
    mixed = F.lit(False)
    for f in FIELDS:
        stated = F.transform(every[f], _text)
        lacks, several = F.array_contains(stated, ""), F.size(F.array_distinct(stated)) > 1
        mixed = mixed | (F.coalesce(F.array_contains("checks", f"same_{f}"), F.lit(False)) & (several | lacks))
        mixed = mixed | (F.coalesce(F.array_contains("required_metadata", f), F.lit(False)) & lacks)
    return calculations.select(
        "set_id", "calculation_id", "expression", "expected", "absolute_tolerance", "relative_tolerance",
        F.coalesce("expected_precision", exact.reported_precision(F.col("expected"))).cast("int").alias("precision"), problem.alias("problem"), mixed.alias("mixed"),
        F.exists(every, lambda v: (_kind(v) == "evidence") & (_text(v["evidence_id"]) == "")).alias("unlinked"), F.exists(every, lambda v: _kind(v) == "assumption").alias("assumption_based"),
        names.alias("names"), every["value"].alias("values"), every["scale"].alias("scales"),
        F.transform(every, lambda v: F.when(_kind(v) == "calculation", _text(v["calculation_id"]))).alias("uses"),
        F.filter(every, lambda v: _text(v["evidence_id"]) != "").alias("citations"),
    )


class _Calculation(NamedTuple):
    set_id: Any
    calculation_id: str
    expression: str
    expected: str | None
    absolute_tolerance: str | None
    relative_tolerance: str | None
    precision: int | None
    problem: str | None
    mixed: bool
    unlinked: bool
    assumption_based: bool
    names: list[str]
    values: list[str | None]
    scales: list[str | None]
    uses: list[str | None]


def _result(c: _Calculation, named: dict[str, tuple[str, str | None]]) -> tuple:
    """(value, difference, within, error), to the digits that decimal arithmetic gives: 38 in the expression, 28 around it."""
    try:
        value = exact.evaluate(c.expression, {name: exact.to_decimal(v) * (_ONE if scale is None or scale == "1" else exact.to_decimal(scale)) for name, (v, scale) in named.items()})
        if c.expected is None:
            return exact.plain(value), None, None, None
        target = exact.to_decimal(c.expected)
        tolerance, share = abs(exact.to_decimal(c.absolute_tolerance or 0)), abs(exact.to_decimal(c.relative_tolerance or 0))
        if c.absolute_tolerance is None and c.relative_tolerance is None and c.precision is not None:
            tolerance = Decimal((0, (5,), -c.precision - 1))
        gap = abs(value - target)
        return exact.plain(value), exact.plain(gap), bool(gap <= tolerance or target and gap / abs(target) <= share), None
    except (ValueError, ArithmeticError) as e:
        return None, None, None, str(e)


def _evaluated(c: _Calculation, results: dict[str, tuple], unbound: bool) -> tuple:
    """The RESULTS of one calculation, from its own values and the usable ones of `results`."""
    named, lost = {}, False
    for name, value, scale, of in zip(c.names, c.values, c.scales, c.uses, strict=True):
        if of is not None:
            earlier = results.get(of)
            value = earlier[0] if earlier and earlier[3] in USABLE else None
            lost = lost or value is None
        if value is not None:
            named[name] = value, scale
    value, gap, within, error = _result(c, named)
    arithmetic = "invalid" if lost or error is not None else "calculated" if within is None else "verified" if within else "discrepancy"
    status = "invalid" if arithmetic == "invalid" else "unlinked" if c.unlinked or unbound else "context_mismatch" if c.mixed else arithmetic
    return value, gap, arithmetic, status, c.assumption_based, error


def _bad(problem: str) -> tuple:
    return None, None, "invalid", "invalid", False, problem


def _solved(rows: list[_Calculation], unbound: set[str], depth: int) -> list[tuple]:
    """The RESULTS of the calculations of one set: round by round those whose earlier results are all there, at last what is on or behind a cycle."""
    ids = {r.calculation_id for r in rows}
    if len(ids) < len(rows) or not all(i and i.strip(" ") for i in ids):
        return [_bad("a calculation_id is blank or repeated")] * len(rows)
    todo = {r.calculation_id: r for r in rows if r.problem is None}
    waits = {i: {u for u in r.uses if u in todo} for i, r in todo.items()}
    results: dict[str, tuple] = {}
    for _ in range(max(1, min(depth, MOST_LAYERS))):
        ready = [i for i in todo if waits[i] <= results.keys()]
        if not ready:
            break
        results |= {i: _evaluated(todo.pop(i), results, i in unbound) for i in ready}
    results |= {i: _evaluated(r, results, i in unbound) for i, r in todo.items()}
    return [results[r.calculation_id] if r.problem is None else _bad(r.problem) for r in rows]


def _values(column: pa.Array) -> list:
    """As to_pylist, but texts and lists of them without a scalar object for each; null lists are empty."""
    if pa.types.is_list(column.type):
        at, flat = column.offsets.to_pylist(), _values(column.flatten())
        return [flat[i - at[0] : j - at[0]] for i, j in zip(at, at[1:], strict=False)]
    if pa.types.is_string(column.type) or pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _solve(depth: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[_Calculation], set[str]]]:
        """Set by set; the rows come sorted, and a set may go on in the next batch."""
        rows, unbound, at = [], set(), None
        for batch in batches:
            for *row, fails in zip(*map(_values, batch.columns), strict=True):
                if row[0] != at:
                    if rows:
                        yield rows, unbound
                    rows, unbound, at = [], set(), row[0]
                if fails:
                    unbound.add(row[1])
                else:
                    rows.append(_Calculation(*row))
        if rows:
            yield rows, unbound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setcontext(Context(prec=28, rounding=ROUND_HALF_EVEN))
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.types[0], pa.string(), *[pa.bool_() if n == "assumption_based" else pa.string() for n in RESULTS]]
        chained = (b for part in ([first], batches) for b in part)
        out: list[tuple] = []
        for rows, unbound in sets(chained):
            out += [(r.set_id, r.calculation_id, *x) for r, x in zip(rows, _solved(rows, unbound, depth), strict=True)]
            if len(out) >= 10_000:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    return run


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["set_id", "calculation_id", *RESULTS])


def verify(calculations: DataFrame, evidence: DataFrame, depth: int = MOST_LAYERS) -> DataFrame:
    """(set_id, calculation_id, calculated, difference, arithmetic_status, status, assumption_based, error).

    Sets of too many calculations are found by their counts and never brought together. All others meet in one shuffle, along with
    those of their calculations whose citations fail, and each is solved in rounds: a round evaluates what has all its earlier
    results, `depth` of them at most; calculations on or behind a cycle stay invalid.
    """
    set_id = calculations.schema["set_id"].dataType
    large = calculations.groupBy("set_id").agg(F.count("*").alias("_n")).where(F.col("set_id").isNotNull() & (F.col("_n") > MOST_CALCULATIONS)).select("set_id")
    large = written(large, "large")
    every = written(described(calculations.where("set_id is not null").join(large, "set_id", "left_anti")), "calculations")
    cited = every.where("problem is null").select("set_id", "calculation_id", F.explode("citations").alias("v"))
    marks = failing(cited, evidence)
    fields = [F.lit(None).cast(every.schema[f].dataType).alias(f) for f in _Calculation._fields[2:]]
    rows = every.select(*_Calculation._fields, F.lit(False).alias("fails")).unionByName(marks.select("set_id", "calculation_id", *fields, F.lit(True).alias("fails")))
    schema = StructType([StructField("set_id", set_id), StructField("calculation_id", StringType()), *[StructField(n, BooleanType() if n == "assumption_based" else StringType()) for n in RESULTS]])
    solved = rows.repartition("set_id").sortWithinPartitions("set_id").mapInArrow(_solve(depth), schema)
    none = F.lit(None).cast("string")
    refused = lambda df, why: df.select("set_id", "calculation_id", none.alias("calculated"), none.alias("difference"), F.lit("invalid").alias("arithmetic_status"), F.lit("invalid").alias("status"), F.lit(False).alias("assumption_based"), F.lit(why).alias("error"))
    too_many = refused(calculations.join(large, "set_id", "left_semi"), f"more than {MOST_CALCULATIONS} calculations")
    return solved.unionByName(too_many).unionByName(refused(calculations.where("set_id is null"), "set_id is null"))


def set_status(results: DataFrame) -> DataFrame:
    return roll_up(results, ["set_id"])
