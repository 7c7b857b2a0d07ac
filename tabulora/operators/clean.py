"""Cleaning of lines and the predicates by which lines are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulora.functions.text import LINE_END, _col, collapse, found, has_any, let, lines, matches, settle, starts_any, strip
from tabulora.plans import rules


def is_noise(line) -> Column:
    """Page numbers, running headers of reports, lines of contents, notes of disclaimers."""
    line = _col(line)
    header = F.contains(line, F.lit("股份有限公司")) & F.contains(line, F.lit("报告")) & (F.length(line) <= 40) & ~(F.endswith(line, F.lit("。")) | F.endswith(line, F.lit("：")) | F.endswith(line, F.lit(":")))
    disclaimer = F.startswith(line, F.lit("免责声明")) & (F.length(line) > 12)
    return matches(line, r"\d+\s*/\s*\d+") | header | found(line, r"[\.。·…]{8,}\s*\d+") | F.startswith(line, F.lit("请务必阅读正文之后的")) | disclaimer


def clean_text(text) -> Column:
    """Stripped lines that are neither empty nor noise."""
    return F.array_join(F.filter(lines(text), lambda x: ~is_noise(x)), "\n")


def clean_elements(elements: DataFrame) -> DataFrame:
    """elements with cleaned content, without those that are left empty."""
    return elements.withColumn("content", clean_text("content")).where("content <> ''")


def is_toc_line(line) -> Column:
    return found(line, rules.TOC_TAIL)


def toc_pages(page_lines: DataFrame, mark: str | None = None) -> DataFrame:
    """(doc_id, page) of the pages with at least four lines of contents; mark: a column that says which lines are."""
    return page_lines.where(F.col(mark) if mark else is_toc_line("text")).groupBy("doc_id", "page").count().where("count >= 4").select("doc_id", "page")


def is_report_title(line) -> Column:
    line = _col(line)
    return has_any(line, ["年度报告", "半年度报告", "季度报告"]) & (F.length(line) <= 40) & ~has_any(line, ["真实性", "完整性"])


def is_row_heading(line) -> Column:
    return _col(line).isin(rules.GENERIC_TITLES) | has_any(line, rules.ROW_WORDS)


def is_section_heading(line) -> Column:
    def of(line: Column) -> Column:
        number = matches(line, r"\d+\s*/\s*\d+") | matches(line, r"\d+(?:\.\d+)?%?")
        barred = (F.length(line) > 120) | is_report_title(line) | is_row_heading(line) | is_toc_line(line) | number
        return (has_any(line, rules.SECTION_WORDS) | found(line, rules.STRONG_HEADING)) & ~barred

    return let(line, of)


def is_open_heading(line) -> Column:
    """A heading's number without its words."""
    return found(line, rules.OPEN_HEADING)


def heading(line) -> Column:
    """A heading in normal form: one space between words, a numbered sentence only up to its first stop."""
    return let(collapse(line), lambda h: F.substring(F.when(found(h, r"^\d+\.(?!\d)"), strip(F.element_at(F.split(h, "[。；;:：]", 2), 1))).otherwise(h), 1, 120))


def bare_title(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" |：:。."))


def title_candidate(text) -> Column:
    """A title of 4 to 40 characters that is more than a number, else empty."""
    return let(bare_title(text), lambda t: F.when((F.length(t) < 4) | matches(t, r"[\d,.\-/]+"), F.lit("")).otherwise(F.substring(t, 1, 40)))


def is_weak_title(title) -> Column:
    """A title that does not name its table."""
    def of(t: Column) -> Column:
        unit = starts_any(t, ["单位：", "单位:", "币种：", "币种:"])
        boxes = matches(t, r"[√□]?(?:适用)?[√□]?(?:不适用)?")
        return (t == "") | t.isin(rules.GENERIC_TITLES) | unit | boxes | matches(t, r"[\d,.\-/]+") | is_row_heading(t) | matches(t, r"[（(]?\d+[）)].*")

    return let(bare_title(F.coalesce(_col(title), F.lit(""))), of)


def titles(line_array, head: str) -> Column:
    """Lines that start with a mark such as 表 or 图, in order."""
    return F.filter(_col(line_array), lambda x: F.startswith(x, F.lit(head)) & (F.length(x) <= 120))


def figure_caption(text) -> Column:
    every = F.transform(F.split(_col(text), LINE_END), strip)
    return F.substring(F.try_element_at(F.filter(every, lambda x: starts_any(x, ["图", "Figure", "figure"])), F.lit(1)), 1, 120)


def glued_lines(page_lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, y, seq, text) with a heading's number put before the words of the next line.

    Pairs are taken from the top and do not overlap: in a run of open headings that all have a short follower, every
    other line starts a pair. A line's place in its run comes from a window, so no page is gathered into one row.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "page").orderBy("y", "seq")
    rows = settle(page_lines, text=collapse("text")).where("text <> ''")
    rows = rows.withColumn("after", F.lead("text").over(order)).withColumn("can", F.coalesce(is_open_heading("text") & (F.length("after") <= 40), F.lit(False)))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("stop", F.max(F.when(~F.col("can"), F.col("n"))).over(order))
    place = F.col("n") - F.coalesce("stop", F.lit(0))
    rows = rows.withColumn("starts", F.col("can") & (F.pmod(place, F.lit(2)) == 1)).withColumn("eaten", F.coalesce(F.lag("starts").over(order), F.lit(False)))
    text = F.when(F.col("starts"), F.concat("text", "after")).otherwise(F.col("text"))
    return rows.where("not eaten").select("doc_id", "page", "y", "seq", text.alias("text"))
