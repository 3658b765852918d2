"""Scalar text functions as column expressions: names, types, years, languages, symbols, URLs, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def contains_any(c: Column, hints: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(h) for h in hints])


def or_default(c: Column, fallback: str) -> Column:
    return F.when(c == "", F.lit(fallback)).otherwise(c)


def safe_name(c: Column, fallback: str = "document", longest: int = 120) -> Column:
    """Characters that paths forbid become one underscore, so does white space; at most `longest` characters."""
    clean = F.regexp_replace(text_of(c), r'[\\/:*?"<>|\r\n\t]+', "_")
    clean = F.regexp_replace(clean, r"^[ ._]+|[ ._]+$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s+", "_"), "_+", "_")
    return F.substring(or_default(clean, fallback), 1, longest)


def safe_slug(c: Column, fallback: str = "document", longest: int = 80) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(text_of(c))), "[^0-9a-zA-Z一-鿿]+", "_")
    return F.substring(or_default(F.regexp_replace(clean, "^_+|_+$", ""), fallback), 1, longest)


def language(title: Column, declared: Column | None = None) -> Column:
    """ZH or EN: as declared by a known code, else by the letters of the title."""
    by_title = F.when(text_of(title).rlike(CJK), "ZH").otherwise("EN")
    if declared is None:
        return by_title
    code = F.upper(F.trim(text_of(declared)))
    return F.when(code.isin("ZH", "CN", "CHS", "CHT", "SC", "TC"), "ZH").when(code.isin("EN", "ENG"), "EN").otherwise(by_title)


def document_type(declared: Column, title: Column) -> Column:
    """The first rule that matches decides."""
    both = F.lower(F.concat_ws(" ", text_of(declared), text_of(title)))
    rules = (  # fixed values
        ("annual_report", ("annual report", "年度报告", "年报")),
        ("interim_report", ("interim", "半年度", "半年报")),
        ("quarterly_report", ("quarter", "季度", "季报")),
        ("prospectus", ("prospectus", "招股", "global offering")),
        ("offering_document", ("offering", "募集说明书")),
    )
    out = None
    for name, hints in rules:
        out = (F if out is None else out).when(contains_any(both, hints), name)
    return out.otherwise(safe_slug(or_default(text_of(declared), "filing"), longest=40))


def report_year(title: Column, published: Column, declared: Column | None = None) -> Column:
    """Declared, else the first 19xx or 20xx of the title, else of the time of publication, else 'undated'."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text_of(c), r"(?:19|20)\d{2}", 0), F.lit("")) for c in (title, published)], F.lit("undated"))
    return found if declared is None else F.coalesce(F.nullif(declared.cast("string"), F.lit("")), found)


def company_short_name(market: Column, name: Column) -> Column:
    a_name = F.regexp_replace(text_of(name), "股份有限公司|有限责任公司|有限公司|集团股份|集团", "")
    a_part = F.regexp_extract(a_name, r"[一-鿿A-Za-z0-9\-]+", 0)
    h_name = F.regexp_replace(text_of(name), r"(?i)\b(HOLDINGS?|GROUP|LIMITED|LTD|INC|CORPORATION|CORP|COMPANY|CO)\b\.?", "")
    h_part = F.regexp_replace(F.regexp_replace(h_name, r"\s+", "_"), "^[_ .]+|[_ .]+$", "")
    chosen = F.when(F.upper(text_of(market)).startswith("A"), F.when(a_part == "", a_name).otherwise(a_part)).otherwise(h_part)
    return safe_name(chosen, "company", 40)


def document_id(market: Column, symbol: Column, year: Column, kind: Column, lang: Column, short_name: Column) -> Column:
    head = [F.upper(safe_slug(market, "M", 8)), F.upper(safe_slug(symbol, "UNKNOWN", 16))]
    return safe_name(F.concat_ws("_", *head, year, kind, lang, short_name), longest=140)


def a_symbol(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text_of(c))), r"SH|SZ|BJ|\.", "")


def a_exchange(c: Column) -> Column:
    s = a_symbol(c)
    return F.when(s.rlike("^[69]"), "SH").when(s.rlike("^[48]|^920"), "BJ").otherwise("SZ")


def h_symbol(c: Column) -> Column:
    """Five digits."""
    s = F.regexp_replace(F.upper(F.trim(text_of(c))), r"HK|\.", "")
    return F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s)


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(c), "<[^>]+>", ""), r"\s+", " "))


def phrase(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"\s+", " "))


def compact(c: Column) -> Column:
    """Lower case without white space: what substring scores are counted on."""
    return F.regexp_replace(F.lower(text_of(c)), r"\s+", "")


def file_size_of_label(c: Column) -> Column:
    """Bytes of labels such as 1.5MB or 300 KB; null for others."""
    label = F.upper(text_of(c))
    number = F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|B)", 1)
    unit = F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|B)", 2)
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1)
    return F.when(number != "", (number.try_cast("double") * factor).cast("long"))


def date_of_url(c: Column) -> Column:
    """yyyy-MM-dd from a path such as /2018/0907/…, else null."""
    part = F.regexp_extract(text_of(c), r"/(\d{4})/(\d{4})/", 0)
    return F.when(part != "", F.concat(F.substring(part, 2, 4), F.lit("-"), F.substring(part, 7, 2), F.lit("-"), F.substring(part, 9, 2)))


def sequence_of_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), r"/([^/]+)\.pdf", 1), F.lit(""))


def chinese_twin_url(c: Column) -> Column:
    """The paired Chinese file: the number one higher, with _c, in the same folder."""
    name = F.regexp_extract(text_of(c), r"/(\d+)\.pdf$", 1)
    plus = F.lpad((name.try_cast("decimal(38,0)") + 1).cast("string"), F.length(name), F.lit("0"))
    return F.when(name != "", F.concat(F.regexp_replace(text_of(c), r"\d+\.pdf$", ""), plus, F.lit("_c.pdf")))


# Hints of the query router, in the order of its rules.
ACCOUNTING = ("会计", "确认", "政策", "处理", "列报", "披露", "附注", "收入确认", "会计处理", "recognition", "accounting", "accounting policy", "accounting policies", "accounting treatment", "presentation")
PROFILE = ("公司资料", "注册地", "上市日期", "profile", "company profile")
FINANCIAL = ("资产负债表", "利润表", "现金流量表", "roe", "毛利率", "财务指标", "financial", "收入", "营收", "净利润", "营业收入", "revenue", "net profit")
COMPANY_DATA = ("分红", "派息", "股东", "股东户数", "股本", "高管持股")
PROSPECTUS = ("招股书", "招股说明书", "上市文件", "募集说明书", "phip", "prospectus", "application proof")
FILING = ("年报", "中报", "季报", "财报", "公告", "通函", "业绩公告", "annual report", "financial report")
DOWNLOAD = ("下载", "download")
HONG_KONG = ("港股", "香港", "hk")
IPO = ("ipo", "新股", "新上市")
IPO_LIST = ("新增", "至今", "名单", "清单", "列表", "list", "全年", "所有", "全部", "公司list", "上市公司")
LOCAL_EVIDENCE = ("原因", "为什么", "风险", "业务模式", "管理层讨论", "募投项目", "变化解释")
BUSINESS_MODEL = ("收入模式", "收入来源", "业务分部", "业务板块", "产品结构", "分行业", "分产品", "主营业务", "revenue model", "revenue stream", "revenue breakdown", "operating segment", "reportable segment", "business segment")

ROUTES = (
    ("prospectus_search_download_ingest", (PROSPECTUS,)),
    ("unsupported_hk_ipo_annual_list", (HONG_KONG, IPO, IPO_LIST)),
    ("filing_search_download_ingest", (DOWNLOAD, FILING)),
    ("local_document_evidence", (BUSINESS_MODEL,)),
    ("local_document_evidence", (ACCOUNTING,)),
    ("structured_profile", (PROFILE,)),
    ("structured_financials", (FINANCIAL,)),
    ("structured_company_data", (COMPANY_DATA,)),
    ("filing_search_download_ingest", (FILING,)),
    ("local_document_evidence", (LOCAL_EVIDENCE,)),
)
OTHER_ROUTE = "hybrid_structured_and_filing_evidence"
MODEL_ROUTES = ("local_document_evidence", OTHER_ROUTE, "unsupported_hk_ipo_annual_list")


def route(query: Column) -> Column:
    """The first route of which every group of hints has one in the query."""
    q, out = F.lower(text_of(query)), None
    for name, groups in ROUTES:
        out = (F if out is None else out).when(reduce(lambda a, b: a & b, [contains_any(q, g) for g in groups]), name)
    return out.otherwise(OTHER_ROUTE)


def needs_model(routed: Column) -> Column:
    return routed.isin(*MODEL_ROUTES)
