"""Rules on requests, titles, sources and ids of filings as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, file_size_of_label, or_default, text_of

# Hints of requests, in the order in which they are tried.
INDICATOR_HINTS = ("roe", "毛利率", "财务指标", "margin", "指标")
STATEMENT_HINTS = (
    ("balance_sheet", ("资产负债表", "balance sheet", "balance")),
    ("cashflow_statement", ("现金流量表", "现金流", "cash flow", "cashflow")),
    ("income_statement", ("利润表", "损益表", "income statement", "profit statement", "p&l")),
    ("financial_statements", ("三张表", "财务报表", "financial statements")),
)
ACCOUNTING_HINTS = ("会计", "确认", "政策", "处理", "列报", "披露", "附注", "记账", "accounting", "recognition", "recognize", "recognised", "recognized", "policy", "policies", "treatment", "presentation", "disclosure")
INCENTIVE_HINTS = ("补贴", "优惠券", "代金券", "消费券", "激励", "外卖", "骑手", "subsid", "incentive", "coupon", "voucher", "courier")
BUSINESS_HINTS = ("收入模式", "收入来源", "业务分部", "业务板块", "产品结构", "分行业", "分产品", "主营业务", "業務分部", "業務板塊", "產品結構", "收入來源", "分行業", "分產品", "主要業務", "revenue model", "revenue stream", "revenue breakdown", "operating segment", "reportable segment", "business segment")
ANALYSIS_HINTS = ("fp&a", "fpa", "预算", "预测", "滚动", "驱动", "分析师", "经营", "利润", "盈利", "亏损", "margin", "driver", "forecast", "budget", "p&l") + BUSINESS_HINTS
ACCOUNTING_NAMES = ("accounting_policy", "accounting", "filing_analysis")
FINANCIAL_NAMES = ("financial_analysis", "financial", "fpna", "fpa", "fp&a")
TABLE_WORDS = ("募集资金", "前五大客户", "主营构成", "主营", "分部收入", "分部", "资产负债表", "利润表", "现金流量表")
OVERSEAS = ("overseas regulatory announcement", "海外監管公告", "海外监管公告")
H_SHARE = ("h股公告", "港股公告", "h-share announcement")
NO_REPORT = ("summary", "摘要", "notice of publication", "notification", "reply form", "form of proxy", "overseas regulatory announcement", "海外監管公告")
A_PROSPECTUS = ("招股说明书", "招股意向书", "上市公告书", "首发")
DIGITS = ("0123456789", "零一二三四五六七八九")
# What the title of an annual report looks like. @ stands for its year, in digits or as it is spoken.
YEAR_BESIDE_REPORT = (r"\b@\s+ANNUAL\s+REPORT\b", r"\bANNUAL\s+REPORT(?:\s+AND\s+ACCOUNTS)?\s+@\b")
ONLY_YEAR_AND_REPORT = (r"^(?:fiscal year )?@ annual report(?: and accounts)?(?:\s*\([^)]*\))?$", r"^annual report(?: and accounts)? @(?:\s*\([^)]*\))?$")
ONLY_CHINESE_YEAR_AND_REPORT = "^(?:@)(?:年年報|年報|年度報告)$"
CHINESE_REPORT, CHINESE_INTERIM = ("年報", "年度報告"), ("中期", "半年度", "季度")
ANY_YEAR, ANY_SPOKEN_YEAR = "(?:19|20)[0-9]{2}", "[二〇零一二三四五六七八九]{4}"
LEAST_REPORT_BYTES = 1 << 20


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"\s+", " "))


def requested_statement(query: Column) -> Column:
    """The first group of hints that has one in the query; null for none."""
    q, out = F.lower(text_of(query)), None
    for name, hints in STATEMENT_HINTS:
        out = (F if out is None else out).when(contains_any(q, hints), name)
    return out


def wants_indicators(query: Column) -> Column:
    return contains_any(F.lower(text_of(query)), INDICATOR_HINTS)


def strategy(query: Column, asked: Column) -> Column:
    """accounting_policy, financial_analysis or basic: by name, or by hints where auto is asked; accounting is tried first."""
    name, q = or_default(F.lower(F.trim(text_of(asked))), "basic"), F.lower(text_of(query))
    auto = name == "auto"
    accounting = name.isin(*ACCOUNTING_NAMES) | (auto & contains_any(q, ACCOUNTING_HINTS))
    financial = name.isin(*FINANCIAL_NAMES) | (auto & contains_any(q, ANALYSIS_HINTS))
    return F.when(accounting, "accounting_policy").when(financial, "financial_analysis").otherwise("basic")


def is_candidate(error: Column, pdf_url: Column, detail_url: Column) -> Column:
    """No error, and some address."""
    return (text_of(error) == "") & ((text_of(pdf_url) != "") | (text_of(detail_url) != ""))


def source_url(pdf_url: Column, detail_url: Column) -> Column:
    return F.coalesce(F.nullif(pdf_url, F.lit("")), F.nullif(detail_url, F.lit("")))


def is_listing_package(kind: Column, pdf_url: Column, detail_url: Column, host: str = "hkexnews.hk") -> Column:
    url = F.lower(text_of(detail_url))
    return (kind == "prospectus") & (url.endswith(".htm") | url.endswith(".html")) & url.contains(host) & (text_of(pdf_url) == "")


def is_overseas_notice(title: Column) -> Column:
    return contains_any(one_line(title), OVERSEAS)


def is_h_share_notice(title: Column) -> Column:
    return contains_any(one_line(title), H_SHARE)


def spoken_years(year: Column) -> list[Column]:
    """A year in digits and in both Chinese ways to write it."""
    digits = year.cast("string")
    spoken = F.translate(digits, *DIGITS)
    return [digits, spoken, F.replace(spoken, F.lit("零"), F.lit("〇"))]


def title_forms(title: Column) -> dict[str, Column]:
    """A title as the rules read it: on one line in lower case, in capitals, and without white space."""
    up = F.upper(text_of(title))
    return {"line": one_line(title), "capitals": up, "tight": F.regexp_replace(up, r"\s+", "")}


def names_year(form: Column, patterns: tuple[str, ...], year: Column) -> Column:
    """Whether one of the patterns is found, with the year of the row in place of @."""
    return reduce(or_, [F.regexp_like(form, F.replace(F.lit(p), F.lit("@"), year)) for p in patterns])


def is_annual_report_of(title: Column, year: Column) -> Column:
    """An English title with year and annual report side by side, or a Chinese one with both and no interim mark."""
    form = title_forms(title)
    chinese = reduce(or_, [form["tight"].contains(y) for y in spoken_years(year)]) & contains_any(form["tight"], CHINESE_REPORT) & ~contains_any(form["tight"], CHINESE_INTERIM)
    return names_year(form["capitals"], YEAR_BESIDE_REPORT, year.cast("string")) | chinese


def is_sure_annual_report(title: Column, size_label: Column, lang: str, year: int | None = None) -> Column:
    """Large enough, no word of other documents, and nothing in the title but year and annual report."""
    form = title_forms(title)
    if lang.upper().startswith("EN"):
        bare = names_year(form["line"], ONLY_YEAR_AND_REPORT, F.lit(ANY_YEAR if year is None else str(year)))
    else:
        spoken = [ANY_YEAR, ANY_SPOKEN_YEAR] if year is None else spoken_years(F.lit(year))
        bare = names_year(F.regexp_replace(text_of(title), r"\s+", ""), (ONLY_CHINESE_YEAR_AND_REPORT,), F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(x) for x in spoken]))
    return F.coalesce(file_size_of_label(size_label) >= LEAST_REPORT_BYTES, F.lit(False)) & ~contains_any(form["line"], NO_REPORT) & bare


def prospectus_rank(category: Column, kind: Column, pdf_url: Column) -> Column:
    """struct(category, pdf): 0 for a listing document that offers subscription, 1 for other listing documents, 2 for others, 3 for notices; a PDF before other addresses."""
    c = one_line(F.coalesce(F.nullif(category, F.lit("")), kind))
    offer = (c.contains("listing documents") & c.contains("offer for subscription")) | (c.contains("上市文件") & c.contains("發售以供認購"))
    notice = contains_any(c, ("formal notice", "announcements and notices", "正式通告", "公告及通告"))
    rank = F.when(offer, 0).when(contains_any(c, ("listing documents", "上市文件")), 1).when(notice, 3).otherwise(2)
    return F.struct(rank.alias("category"), F.when(F.lower(text_of(pdf_url)).endswith(".pdf"), 0).otherwise(1).alias("pdf"))


def is_a_prospectus(title: Column) -> Column:
    return contains_any(text_of(title), A_PROSPECTUS)


def is_whole_annual_report(title: Column, year: int | None = None) -> Column:
    """A title of the year asked, if one is, and no summary."""
    t = text_of(title)
    return ~t.contains("摘要") & (t.contains(str(year)) if year is not None else F.lit(True))


def id_problem(document_id: Column) -> Column:
    """Why an id cannot be one part of a path, else null."""
    c = text_of(document_id)
    return (
        F.when(c == "", "empty").when((c != F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))) | c.endswith("."), "unsafe ends").when(c.contains("/") | c.contains("\\"), "separator")
        .when(c.rlike("^[A-Za-z]:"), "absolute").when(c.rlike(r'[<>:"|?*\x00-\x1f]'), "unsafe characters")
    )


def is_within(path: Column, folder: Column) -> Column:
    """A path below a folder, without steps upwards."""
    return F.startswith(path, F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def has_table_words(text: Column) -> Column:
    return contains_any(text_of(text), TABLE_WORDS)


def canonical_symbol(market: Column, asked: Column, found: Column) -> Column:
    """The exchange's new code (920...) where an old one (4..., 8...) was asked; else as asked."""
    old, new = F.regexp_replace(text_of(asked), r"\D", ""), F.regexp_replace(text_of(found), r"\D", "")
    return F.when(F.upper(text_of(market)).startswith("A") & new.startswith("920") & old.rlike("^(4|8|920)"), new).otherwise(asked)


def signature(source: Column, params: dict[str, Column]) -> Column:
    """source|{"name":"value",...}: names sorted, values trimmed, null as the empty text."""
    values = F.struct(*[F.trim(text_of(params[k])).alias(k) for k in sorted(params)])
    return F.concat(F.lower(F.trim(source)), F.lit("|"), F.to_json(values))


def cache_key(provider: Column, interface: Column, params: Column) -> Column:
    """provider_interface_digest.json"""
    return F.concat_ws("_", provider, interface, F.concat(F.left(F.sha2(params, 256), F.lit(32)), F.lit(".json")))


def byte_prefix(text: Column, most: int) -> Column:
    """As many whole letters as fit into `most` bytes of UTF-8. A letter has four bytes at most, so one of four cuts is between letters."""
    cut = lambda n: F.try_validate_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*[cut(most - k) for k in range(min(4, most + 1))]))


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd from that or from yyyyMMdd; null for others."""
    t = F.trim(text_of(c))
    return F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)


def shanghai_time(milliseconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in Shanghai; the empty text for null."""
    utc = F.timestamp_add("MILLISECOND", milliseconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), utc), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def merged(old: Column, new: Column) -> Column:
    """new, unless it is null or blank."""
    return F.coalesce(F.nullif(new.cast("string"), F.lit("")), old.cast("string"))


def clean_number(c: Column) -> Column:
    """NaN and infinite values as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def first_present(*values: Column) -> Column:
    """The first value that is no blank and no mark for a missing one."""
    return F.coalesce(*[F.when(~F.lower(F.trim(v.cast("string"))).isin("", "nan", "nat", "none", "-", "--"), F.trim(v.cast("string"))) for v in values])


def jsonp(text: Column) -> Column:
    """The payload of callback(...);"""
    return F.regexp_replace(text_of(text), r"(?s)^[^(]*\((.*)\)\s*;?\s*$", "$1")
