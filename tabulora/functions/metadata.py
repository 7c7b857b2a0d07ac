"""Report metadata out of titles and texts: ticker, company, date, industry, period, currency and unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulora.functions.text import SPACE, _col, collapse, first_match, has_any, let, squeeze, strip
from tabulora.plans import rules

CJK = "[一-鿿]"


def ticker(s) -> Column:
    """The first run of exactly six digits."""
    return first_match(s, r"(?U)(?<!\d)(\d{6})(?!\d)")


def stock_code(s) -> Column:
    """All digits, if there are six; else null."""
    digits = F.regexp_replace(_col(s), r"(?U)\D", "")
    return F.when(F.length(digits) == 6, digits)


def company(title) -> Column:
    """Leading name parts of a title of the form code_name_year_report, else what stands before a colon or a dash."""
    title = _col(title)
    parts = F.filter(F.transform(F.split(title, rf"(?U)[_\-]|{SPACE}"), strip), lambda x: x != "")
    head = F.try_element_at(parts, F.lit(1))
    parts = F.when(F.coalesce(head.rlike(r"(?U)^\d{6}$"), F.lit(False)), F.slice(parts, 2, 1 << 20)).otherwise(parts)
    state = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("names"))

    def step(s: Column, part: Column) -> Column:
        low = F.lower(part)
        ends = part.rlike(r"(?U)^20\d{2}$") | low.isin(rules.REPORT_MARKERS) | (F.startswith(low, F.lit("q")) & F.endswith(low, F.lit("报")))
        fits = part.rlike(CJK) | (part.rlike("^[A-Za-z]{1,4}$") & (F.size(s.names) > 0))
        stop = s.stop | ends | ~fits
        return F.struct(stop.alias("stop"), F.when(stop, s.names).otherwise(F.concat(s.names, F.array(part))).alias("names"))

    names = F.aggregate(parts, state, step).names
    before = lambda mark: F.substring(strip(F.substring_index(title, mark, 1)), 1, 64)
    return (
        F.when(F.size(names) > 0, F.substring(F.array_join(names, ""), 1, 64))
        .when(F.contains(title, F.lit("：")), before("："))
        .when(F.contains(title, F.lit("-")), before("-"))
    )


def published(s) -> Column:
    """The first date such as 2026-4-30 or 2026年4月30; an impossible one is null."""
    pattern = r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})"
    parts = [F.nullif(F.regexp_extract(_col(s), pattern, k), F.lit("")).cast("int") for k in (1, 2, 3)]
    day = F.try_make_timestamp_ntz(*parts, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(parts[0].isNotNull(), day)


def _canonical(candidate: Column) -> Column:
    def of(compact: Column) -> Column:
        out = None
        for name, words in rules.INDUSTRIES:
            fits = (compact == name.lower()) | has_any(compact, [w.lower() for w in words])
            out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
        return F.when(compact != "", out)

    return let(squeeze(candidate), of)


def industry_from_label(text) -> Column:
    """What follows a label such as 所属行业, as a known industry, or as it is if it has 2 to 16 characters."""
    compact = F.regexp_replace(_col(text), rf"(?U){SPACE}+", "")
    raw = F.regexp_extract(compact, r"(?:所属行业|公司所处行业|所处行业|行业分类)[:：]?(.*?)(?:主营业务|主要业务|经营情况|公司简介|报告期|$)", 1)
    candidate = F.substring(F.trim(raw, F.lit("：:，,；;。 ")), 1, 24)
    return let(candidate, lambda c: F.coalesce(_canonical(c), F.when(F.length(c).between(2, 16), c)))


def industry_from_words(title, text) -> Column:
    """The industry whose words weigh most (a title's 2, a text's 2 or 1), the first of equals, from 2 on."""
    def best(t: Column) -> Column:
        scored = []
        for order, (name, words) in enumerate(rules.INDUSTRIES):
            score = F.lit(0)
            for w in words:
                score = score + F.when(F.contains(t["head"], F.lit(w)), 2).otherwise(0) + F.when(F.contains(t["body"], F.lit(w)), 2 if len(w) >= 3 else 1).otherwise(0)
            scored.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*scored))

    both = F.struct(squeeze(title).alias("head"), squeeze(text).alias("body"))
    return let(let(both, best), lambda b: F.when(b["score"] >= 2, b["name"]))


def industry(title, text, code, known: dict[str, str] | None = None) -> Column:
    """By ticker, by the ticker in the title, by label, by words."""
    known = rules.INDUSTRY_OF if known is None else known
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    look = lambda c: F.when(c.isNotNull(), F.try_element_at(table, c))
    return F.coalesce(look(_col(code)), look(ticker(title)), industry_from_label(text), industry_from_words(title, text))


def period(title, source) -> tuple[Column, Column]:
    """Report period such as 2026Q1 (null without a year) and report type."""
    both = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(source), F.lit("")))
    year, low = first_match(both, r"(20\d{2})"), F.lower(both)
    q1 = F.contains(low, F.lit("q1")) | has_any(both, ["一季报", "第一季度"])
    q3 = F.contains(low, F.lit("q3")) | has_any(both, ["三季报", "第三季度"])
    half, full = has_any(both, ["半年报", "半年度报告"]), has_any(both, ["年报", "年度报告"])
    mark = F.when(q1, "Q1").when(q3, "Q3").when(half, "H1").when(full, "FY").otherwise("")
    kind = F.when(q1 | q3, "quarterly").when(half, "semiannual").when(full, "annual").otherwise("unknown")
    return F.concat(year, mark), kind


def identity(title, source) -> Column:
    """year:kind by which reports of one ticker are the same; null if neither is found."""
    both = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(source), F.lit("")))
    year, low, kind = first_match(both, r"(20\d{2})"), F.lower(both), None
    for marker, name in rules.IDENTITY_MARKERS:
        fits = F.contains(low, F.lit(marker))
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
    unknown = F.lit("unknown")
    return F.when(year.isNotNull() | kind.isNotNull(), F.concat(F.coalesce(year, unknown), F.lit(":"), F.coalesce(kind, unknown)))


def currency_and_unit(raw) -> tuple[Column, Column]:
    """CNY or null, and the unit in which the report's amounts are given."""
    raw = _col(raw)
    window, head = F.substring(raw, 1, 50000), F.substring(raw, 1, 5000)
    named = first_match(head, rf"(?U)单位[:：]{SPACE}*([^\n；;。]{{1,30}})")
    money = F.when(F.contains(window, F.lit("人民币")), "CNY")
    unit = F.nullif(strip(named), F.lit(""))
    unit = F.coalesce(
        unit,
        F.when(F.contains(window, F.lit("人民币百万元")), "人民币百万元")
        .when(F.contains(window, F.lit("百万元")), "百万元")
        .when(window.rlike(rf"(?U)单位[:：]{SPACE}*万元"), "万元")
        .when(window.rlike(rf"(?U)单位[:：]{SPACE}*亿元"), "亿元")
        .when(window.rlike(rf"(?U)单位[:：]{SPACE}*元"), "元"),
    )
    return money, unit


def normal_query(q) -> Column:
    return collapse(q)
