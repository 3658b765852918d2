"""Exact decimal arithmetic for cited calculations.

Spark's decimals lose digits in long divisions, so expressions are evaluated with Python's decimals, one small call for each
row; rows are spread by Spark. Numbers in evidence texts are found natively.
"""

from __future__ import annotations

import ast
import operator
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation, localcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST, MOST_POWER, DIGITS = 500, 12, 38
#: Fixed value: a number with its sign, brackets and percent mark, and what may not stand beside it.
NUMBER = (
    r"(?<![A-Za-z0-9_.,(])(?P<open>\()?\s*(?P<sign>[+-])?\s*(?P<number>(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)"
    r"\s*(?P<percent>%?)\s*(?P<close>\))?(?![A-Za-z0-9_)]|[.,]\d)"
)
_DASHES = str.maketrans("−–—（），", "---(),")
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def to_decimal(value: object) -> Decimal:
    """A finite decimal; thousands separators are dropped; ValueError otherwise."""
    if value is None or isinstance(value, bool):
        raise ValueError("not a number")
    try:
        out = Decimal(str(value).replace(",", "").strip())
    except InvalidOperation:
        raise ValueError("not a number") from None
    if not out.is_finite():
        raise ValueError("not a finite number")
    return out


def plain(value: Decimal) -> str:
    """Without exponent and trailing zeros."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def _integer(x: Decimal, what: str) -> int:
    if x != x.to_integral() or abs(x) > MOST_POWER:
        raise ValueError(f"{what} must be an integer of at most {MOST_POWER}")
    return int(x)


def _visit(node: ast.AST, names: dict[str, Decimal]) -> Decimal:
    match node:
        case ast.Constant():
            return to_decimal(node.value)
        case ast.Name(id=name):
            if name not in names:
                raise ValueError(f"unknown variable {name}")
            return names[name]
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_visit(x, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _visit(x, names)
        case ast.BinOp(left=x, op=op, right=y):
            a, b = _visit(x, names), _visit(y, names)
            if type(op) in _BINARY:
                return _BINARY[type(op)](a, b)
            if isinstance(op, ast.Div):
                if not b:
                    raise ValueError("division by zero")
                return a / b
            if isinstance(op, ast.Pow):
                return a ** _integer(b, "exponent")
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            values = [_visit(x, names) for x in args]
            if name == "abs" and len(values) == 1:
                return abs(values[0])
            if name in ("min", "max") and values:
                return (min if name == "min" else max)(values)
            if name == "round" and len(values) in (1, 2):
                places = _integer(values[1], "digits") if len(values) == 2 else 0
                return values[0].quantize(Decimal((0, (1,), -places)))
    raise ValueError(f"{type(node).__name__} is not allowed")


@lru_cache(maxsize=4096)
def _tree(text: str) -> ast.AST:
    return ast.parse(text, mode="eval").body


def evaluate(expression: str, names: dict[str, Decimal]) -> Decimal:
    """+ - * / ** and abs min max round over named decimals, to 38 digits; ValueError for anything else."""
    text = (expression or "").strip()
    if not 0 < len(text) <= LONGEST:
        raise ValueError("expression must have 1 to 500 characters")
    try:
        tree = _tree(text)
        with localcontext() as context:
            context.prec = DIGITS
            return _visit(tree, names)
    except (SyntaxError, ArithmeticError, RecursionError) as e:
        raise ValueError(str(e) or "arithmetic error") from None


def evaluated(expression: Column, names: Column) -> Column:
    """struct(value, error): the exact value as text of an expression over a map of names to decimal texts, or why there is none."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, maps in batches:
            rows = []
            for text, given in zip(texts, maps, strict=True):
                try:
                    rows.append((plain(evaluate(text, {k: to_decimal(v) for k, v in dict(given or {}).items()})), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["value", "error"])

    return F.pandas_udf(run, "struct<value:string,error:string>")(expression, names)


def normal_form(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(_DASHES)


def nfkc(text: Column) -> Column:
    """NFKC with plain dashes, brackets and commas; Spark has no such function. Texts of ASCII letters stay in the JVM."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form, na_action="ignore")


def number_tokens(text: Column) -> Column:
    """array<struct<value decimal(38,9), percent boolean>>: the numbers of a text, brackets around one meaning minus; unbalanced brackets are left out."""
    plain_text = F.translate(F.coalesce(text, F.lit("")), "−–—（），", "---(),")
    parts = F.regexp_extract_all(plain_text, F.lit(re.sub(r"\(\?P<\w+>", "(", NUMBER)), F.lit(0))
    kept = F.filter(parts, lambda t: t.contains("(") == t.contains(")"))
    digits = lambda t: F.regexp_replace(t, r"[^0-9.]", "").try_cast("decimal(38,9)")
    found = F.transform(kept, lambda t: F.struct((digits(t) * F.when(t.contains("-") | t.contains("("), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")).cast("decimal(38,9)").alias("value"), t.contains("%").alias("percent")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def source_target(value: Column, source_format: Column, relation: Column) -> Column:
    """What has to stand in the source: complements count from 100 or from 1, ratios are percents there."""
    of = F.when(relation == "equal", value).when(source_format == "percent", F.lit(100) - value).otherwise(F.lit(1) - value)
    return F.when(source_format == "ratio", of * 100).otherwise(of).cast("decimal(38,9)")


def source_matches(tokens: Column, value: Column, source_format: Column, relation: Column) -> Column:
    target = source_target(value, source_format, relation)
    return F.exists(tokens, lambda t: (t["value"] == target) & (t["percent"] == (source_format != "number")))


def reported_precision(expected: Column) -> Column:
    """Digits after the point as the text gives them, less its exponent; null without a point."""
    form = r"^[+-]?\d+(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
    clean = F.regexp_replace(F.trim(expected), ",", "")
    digits = F.length(F.regexp_extract(clean, form, 1))
    power = F.coalesce(F.nullif(F.regexp_extract(clean, form, 2), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(clean.rlike(form) & (digits > 0), F.greatest(digits - power, F.lit(0)))


def within(difference: Column, expected: Column, absolute: Column, relative: Column) -> Column:
    return (difference <= absolute) | ((expected != 0) & (difference <= relative * F.abs(expected)))
