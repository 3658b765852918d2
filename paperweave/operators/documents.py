"""Documents: page roll-ups, completeness, identity, candidates for a filing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.text import CJK, contains_any, document_type, text_of

# What marks each section of an annual report and of a prospectus.
ANNUAL_SECTIONS = {
    "auditor_report": (r"auditor(?:s|[’']s)?\s+report", r"independent\s+auditors?[’'`s]*\s+report", r"independent\s+auditor.{0,6}report", r"report\s+of\s+the\s+independent\s+auditors?", "獨立核數師報告", "独立核数师报告", "獨立審計師報告", "独立审计师报告", "核數師報告", "核数师报告", "審計報告", "审计报告"),
    "financial_statements": (r"financial\s+statements", "財務報表", "财务报表", "財務報告", "财务报告"),
    "notes": (r"notes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+(?:statements|accounts)", r"notes?\s+on\s+(?:the\s+)?(?:consolidated\s+)?financial\s+(?:statements|accounts)", r"財\s*務(?:報\s*表|報\s*告)\s*附\s*註", r"财\s*务(?:报\s*表|报\s*告)\s*附\s*注", r"財\s*務\s*報\s*表.{0,12}註\s*釋", r"财\s*务\s*报\s*表.{0,12}注\s*释", "會計報表附註", "会计报表附注"),
    "financial_position": (r"statement\s+of\s+financial\s+position", r"balance\s+sheet", "財務狀況表", "财务状况表", "資產負債表", "资产负债表"),
    "profit_or_loss": (r"statement\s+of\s+(?:profit\s+or\s+loss|comprehensive\s+income)", r"income\s+statement", "綜合收益表", "综合收益表", "合併利潤表", "合并利润表", "利潤表", "利润表", "損益表", "损益表"),
}
PROSPECTUS_SECTIONS = {
    "offering_title": (r"\bprospectus\b", r"\bglobal\s+offering\b", "招股章程", "招股說明書", "招股说明书", "全球發售", "全球发售"),
    "risk_factors": (r"risk\s+factors", "風險因素", "风险因素"),
    "business": (r"\bbusiness\b", "業務", "业务与技术", "业务和技术"),
    "financial_information": (r"financial\s+information", "財務資料", "财务资料", "財務會計資料", "财务会计信息"),
    "accountants_report": (r"accountants?[’'`s]*\s+report", r"report\s+of\s+the\s+reporting\s+accountants?", "會計師報告", "会计师报告", "申報會計師報告", "申报会计师报告"),
}


def quality_rollup(pages: DataFrame) -> DataFrame:
    """One row for each document: size, lists of pages with little or garbled text, score. pages: document_id, page_no, text, optionally extraction_method."""
    method = F.col("extraction_method") if "extraction_method" in pages.columns else F.lit(None).cast("string")
    text = text_of(F.col("text"))
    marked = pages.select("document_id", "page_no", F.length(text).alias("n"), quality.is_low_text(F.col("text")).alias("low"), quality.metrics(F.col("text"))["garbled"].alias("garbled"), method.alias("method"))
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("page_no"))))
    out = marked.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.sum("n").alias("char_count"), F.avg("n").alias("avg_chars"),
        listed(F.col("low")).alias("low_text_pages"), listed(F.col("garbled")).alias("garbled_pages"),
        listed(F.col("method") == "pypdf_fallback").alias("fallback_pages"), listed(F.col("method") == "failed").alias("failed_pages"),
    )
    ratio = F.size("garbled_pages") / F.col("page_count")
    return out.withColumn("garbled_ratio", ratio).withColumn("quality_score", F.least(F.lit(1.0), F.col("avg_chars") / quality.FULL_PAGE) * (1 - ratio))


#: Without one of these letters no pattern of a section matches; a cheap test before the patterns.
NEEDED = {
    "auditor_report": ("auditor", "師報告", "师报告", "計報告", "计报告"), "financial_statements": ("financial", "財務", "财务"), "notes": ("note", "註", "注"),
    "financial_position": ("financial", "balance", "狀況表", "状况表", "負債表", "负债表"), "profit_or_loss": ("statement", "收益表", "利潤表", "利润表", "損益表", "损益表"),
    "offering_title": ("prospectus", "global", "招股", "全球"), "risk_factors": ("risk", "風險", "风险"), "business": ("business", "業務", "业务"),
    "financial_information": ("financial", "財務", "财务"), "accountants_report": ("accountant", "會計師", "会计师"),
}


def sections_found(body: Column, sections: dict[str, tuple[str, ...]]) -> Column:
    """Names of the sections of which some pattern is in the text. body: lower case, white space as one blank."""
    return F.array_compact(F.array(*[F.when(contains_any(body, NEEDED[name]) & body.rlike("|".join(f"(?:{p})" for p in patterns)), name) for name, patterns in sections.items()]))


def _status(pages: Column, chars: Column, whole: Column, few: int, many: int) -> Column:
    return (
        F.when(pages <= few, "rejected_short_document").when(pages < many, "needs_review_too_few_pages").when(whole, "complete")
        .when((pages >= 60) & (chars < pages * 100), "needs_ocr").otherwise("needs_review_missing_sections")
    )


def completeness(pages: DataFrame, kind: str = "annual_report", few: int | None = None, many: int | None = None) -> DataFrame:
    """Sections found, status and verdict (null: needs OCR) of each document. Sections are looked for page by page, so no document is joined into one text."""
    annual = kind == "annual_report"
    sections = ANNUAL_SECTIONS if annual else PROSPECTUS_SECTIONS
    few, many = few if few is not None else (5 if annual else 15), many if many is not None else (30 if annual else 50)
    once = pages.select("document_id", F.lower(F.regexp_replace(text_of(F.col("text")), r"\s+", " ")).alias("_body"))
    per_page = once.select("document_id", F.length(F.trim("_body")).alias("n"), sections_found(F.col("_body"), sections).alias("s"))
    out = per_page.groupBy("document_id").agg(F.count("*").alias("page_count"), F.sum("n").alias("extracted_chars"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("matched_sections"))
    has = lambda *names: reduce(lambda a, b: a & b, [F.array_contains("matched_sections", n) for n in names])
    if annual:
        whole = has("auditor_report", "notes", "financial_position", "profit_or_loss")
    else:
        whole = has("offering_title", "risk_factors") & (F.size("matched_sections") >= 4)
    out = out.withColumn("status", _status(F.col("page_count"), F.col("extracted_chars"), whole, few, many))
    return out.withColumn("complete", F.when(F.col("status") == "complete", True).when(F.col("status") != "needs_ocr", False))


def identity(documents: DataFrame) -> DataFrame:
    """Year, company and symbol of each row against its text. documents: text, expected_year, expected_company, expected_symbol (each may be null)."""
    text = text_of(F.col("text"))
    year = F.when(F.col("expected_year").isNotNull(), text.contains(F.col("expected_year").cast("string")))
    name = F.regexp_replace(F.lower(text_of(F.col("expected_company"))), "股份有限公司|有限公司|控股集团|控股集團|集团|集團", " ")
    stop = ("company", "corporation", "group", "holdings", "holding", "limited", "ltd", "inc", "plc")
    tokens = F.filter(F.regexp_extract_all(name, F.lit("[0-9a-z]+|[一-鿿]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*stop))
    body = F.regexp_replace(F.lower(text), "[^0-9a-z一-鿿]+", "")
    company = F.when(F.size(tokens) > 0, F.exists(tokens, lambda t: body.contains(t)))
    symbol = F.regexp_replace(F.upper(F.trim(text_of(F.col("expected_symbol")))), r"\.HK", "")
    digits = F.coalesce(F.nullif(F.regexp_replace(symbol, "^0+", ""), F.lit("")), symbol)
    quoted = F.regexp_replace(symbol, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    exact = F.regexp_like(text, F.concat(F.lit("(?i)(?<![0-9])"), quoted, F.lit("(?![0-9])")))
    labelled = F.regexp_like(text, F.concat(F.lit("(?i)(?:stock\\s*code|股份代[號号]|股票代[碼码]|證券代碼|证券代码)[^0-9]{0,24}0*"), F.regexp_replace(digits, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("(?![0-9])")))
    code = F.when(symbol != "", F.upper(text).contains(digits) & (exact | labelled))  # a cheap test before the patterns
    signals = F.array_compact(F.array(company, code))
    return documents.withColumns({"year_match": year, "company_match": company, "symbol_match": code}).withColumn("passed", F.coalesce(F.col("year_match"), F.lit(True)) & ((F.size(signals) == 0) | F.array_contains(signals, True)))


# Words of titles that are no annual report itself.
NEGATIVE_TITLES = ("summary", "摘要", "通知", "通函", "notification", "notice of publication", "reply form", "letter to", "form of proxy", "proxy form", "overseas regulatory announcement", "海外監管公告", "港股公告", "h股公告", "h-share announcement", "esg", "更正", "修订", "修訂")


def candidate_score(kind: str, year: int | None, lang: str) -> Column:
    """Points of a candidate (title, document_type, pdf_url, category) for a request."""
    title = text_of(F.col("title"))
    low = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    cjk, en = title.rlike(CJK), lang.upper().startswith("EN")
    score = F.when(F.lower(text_of(F.col("pdf_url"))).endswith(".pdf"), 20).otherwise(0) + F.when(document_type(F.col("document_type"), title) == kind, 10).otherwise(0)
    if year is not None:
        score = score + F.when(title.contains(str(year)), 10).otherwise(0)
    if en:
        score = score + F.when(~cjk, 3).otherwise(0) - F.when(contains_any(title, ("中文版", "中文版本")), 40).otherwise(0)
    else:
        score = score + F.when(cjk, 3).otherwise(0) - F.when(title.contains("英文版") | ~cjk, 40).otherwise(0)
    if kind == "annual_report":
        digits = str(year) if year is not None else ""
        spoken = digits.translate(str.maketrans("0123456789", "零一二三四五六七八九"))
        y = rf"(?:{digits}|{spoken}|{spoken.replace('零', '〇')})" if year is not None else r"\d{4}"
        exact = rf"^(?:annual report(?: and accounts)? {y}|(?:fiscal year )?{y} annual report(?: and accounts)?)(?:\s*\([^)]*\))?$|^(?:年報|年度報告)\s*{y}$|^{y}\s*(?:年報|年年報|年度報告)$"
        return score + F.when(low.rlike(exact), 35).otherwise(0) + F.when(low.contains("with employee share plans"), 5).otherwise(0) - F.when(contains_any(low, NEGATIVE_TITLES), 45).otherwise(0)
    if kind == "prospectus":
        category = F.trim(F.regexp_replace(F.lower(F.coalesce(F.nullif(text_of(F.col("category")), F.lit("")), text_of(F.col("document_type")))), r"\s+", " "))
        listing = F.when(category.contains("listing documents") & category.contains("offer for subscription"), 45).when(category.contains("listing documents"), 25).otherwise(0)
        return score + listing - F.when(contains_any(category, ("formal notice", "announcements and notices")), 45).otherwise(0)
    return score - F.when(contains_any(low, ("摘要", "summary", "esg", "更正", "修订", "修訂")), 15).otherwise(0)


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(title), r"(?:19|20)\d{2}", 0), F.lit("")).try_cast("int")


def rank_candidates(candidates: DataFrame, group: list[str], year: int | None, order: list[str]) -> DataFrame:
    """Rank by score, then the title's year where no year is asked, then time of publication; `order` breaks ties."""
    years = [F.desc(F.coalesce(title_year(F.col("title")), F.lit(0)))] if year is None else []
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), *years, F.desc("publish_time"), *order)))


def select_candidate(ranked: DataFrame, group: list[str], annual: bool, year: int | None) -> DataFrame:
    """The chosen candidate of each group, or ambiguous: chosen are a single one, a higher score, a later year where none is asked, or the same title at 60 points."""
    low = F.trim(F.regexp_replace(F.lower(text_of(F.col("title"))), r"\s+", " "))
    over = Window.partitionBy(*group).orderBy("rank")
    seen = ranked.where("rank <= 2").withColumns({"_score": F.lead("score").over(over), "_title": F.lead(low).over(over), "_year": F.lead(title_year(F.col("title"))).over(over)}).where("rank = 1")
    clear = F.col("_score").isNull() | (F.col("score") > F.col("_score")) | ((F.col("score") >= 60) & (low == F.col("_title")))
    if annual and year is None:
        clear = clear | (F.coalesce(title_year(F.col("title")), F.lit(0)) > F.coalesce(F.col("_year"), F.lit(0)))
    return seen.withColumn("ambiguous", ~clear).drop("_score", "_title", "_year", "rank")


def disposition(complete: Column, passed: Column, trusted: Column) -> Column:
    """deleted, needs_review or accepted. A failed identity makes a complete document one to review, unless its source is trusted."""
    verdict = F.when(complete & ~passed & ~trusted, F.lit(None).cast("boolean")).otherwise(complete)
    return F.when(verdict.isNull(), "needs_review").when(verdict, "accepted").otherwise("deleted")


# --- tables ------------------------------------------------------------------------------------------------------------
# Words that headers of financial tables are made of.
HEADER_WORDS = ("item", "name", "date", "period", "amount", "total", "项目", "科目", "名称", "日期", "期间", "金额", "单位", "合计", "本期", "上期", "期末", "期初")
_NUMBER = r"^\(?[-+]?\s*(?:[$¥￥€£]\s*)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?\)?$"
_YEAR = r"^(?:19|20)\d{2}(?:年|年度)?$"
_NUMBER_CELL, _YEAR_CELL = re.compile(_NUMBER), re.compile(_YEAR)
STRUCTURE = "header_depth int, confidence double, column_paths array<array<string>>, row_count int, column_count int, quality_flags array<string>"


@lru_cache(maxsize=65536)
def _cell(text: str) -> tuple[bool, bool]:
    """Whether a cell is a number that is no year, and whether it has a word of headers."""
    return not _YEAR_CELL.match(text) and bool(_NUMBER_CELL.match(text)), any(w in text.lower() for w in HEADER_WORDS)


def table_structure(rows: list[list[str | None]]) -> tuple:
    """Depth of the header (1 to 3 rows; 0 where unsure), its confidence, the label path of each column, sizes and flags."""
    blank = lambda x: x is None or not str(x).strip()
    width = max((len(r) for r in rows), default=0)
    if not width:
        return 0, 0.0, [], len(rows), 0, ["empty_table"]
    flags = [name for name, yes in (("ragged_rows", any(len(r) != width for r in rows)), ("contains_null_cells", any(c is None for r in rows for c in r)), ("blank_rows", any(all(map(blank, r)) for r in rows))) if yes]

    # Each cell that a header can depend on is tested once: (number, header word, blank) of the first three rows and the five below.
    seen = [[(False, False, True) if blank(c) else (*_cell(str(c).strip()), False) for c in r] for r in rows[:8]]

    def share(cells: list, test) -> float:
        full = [c for c in cells if not c[2]]
        return sum(map(test, full)) / len(full) if full else 0.0

    number = lambda c: c[0]
    best = (0.0, 0)
    for depth in range(1, min(3, len(rows) - 1) + 1):
        head = [c for r in seen[:depth] for c in r]
        body = [share(r, number) for r in seen[depth : depth + 5]]
        words = share(head, lambda c: c[1])
        boundary = max(0.0, body[0] - share(head, number))
        merged = min(1.0, sum(c[2] for c in head) / (depth * width))
        labels = share(head, lambda c: not c[0])
        best = max(best, (min(1.0, 0.55 * boundary + 0.2 * labels + 0.15 * min(1.0, 3 * words) + 0.05 * median(body) + 0.05 * merged), depth))
    confidence, depth = round(best[0], 3), best[1]
    if confidence < 0.6:
        depth = 0
    flags.append("header_inferred" if depth else "header_low_confidence")
    paths: list[list[str]] = [[] for _ in range(width)] if depth else []
    for r in rows[:depth]:
        label = None
        for i in range(width):
            label = str(r[i]).strip() if i < len(r) and not blank(r[i]) else label
            if label and paths[i][-1:] != [label]:
                paths[i].append(label)
    return depth, confidence, paths, len(rows), width, flags


def structure_of(tables: Column) -> Column:
    """table_structure of array<array<string>>, in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            done = [table_structure([list(r) if r is not None else [] for r in (t if t is not None else [])]) for t in series]
            yield pd.DataFrame(done, columns=["header_depth", "confidence", "column_paths", "row_count", "column_count", "quality_flags"])

    return F.pandas_udf(run, STRUCTURE)(tables)
