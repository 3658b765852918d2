"""Text quality of pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

READABLE_WORDS = 8
LOW_TEXT = 50
FULL_PAGE = 800.0
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def without_layout_marks(c: Column) -> Column:
    return F.translate(text_of(c), "\x02", " ")


def metrics(c: Column) -> Column:
    """struct(control_count, control_ratio, readable_words, readable, garbled)."""
    text = text_of(c)
    solid = F.length(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", ""))
    controls = F.regexp_count(text, F.lit(CONTROLS))
    ratio = controls / F.greatest(F.lit(1), solid)
    suspect = (solid >= 100) & (ratio >= 0.02)
    words = F.when(suspect | (solid < 100), F.least(F.lit(READABLE_WORDS), F.regexp_count(without_layout_marks(c), F.lit("[A-Za-z]{2,}|[一-鿿]{2,}")))).otherwise(READABLE_WORDS)
    readable = words >= READABLE_WORDS
    return F.struct(controls.alias("control_count"), ratio.alias("control_ratio"), words.alias("readable_words"), readable.alias("readable"), (suspect & ~readable).alias("garbled"))


def is_low_text(c: Column) -> Column:
    return F.length(F.regexp_replace(text_of(c), r"^\s+|\s+$", "")) < LOW_TEXT


def page_score(c: Column) -> Column:
    """0 for blank or garbled pages, else the share of a full page."""
    text = text_of(c)
    return F.when((F.trim(text) == "") | metrics(c)["garbled"], 0.0).otherwise(F.least(F.lit(1.0), F.length(text) / FULL_PAGE))


def needs_ocr(c: Column, least_chars: int = 50) -> Column:
    return (F.length(F.trim(text_of(c))) < least_chars) | metrics(c)["garbled"]
