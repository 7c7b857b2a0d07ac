"""Gold seed: a second, independent extractor of candidate lines with a unit for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulora.functions import numbers
from tabulora.functions.metadata import period
from tabulora.functions.text import LINE_END, SPACE, first_match, has_any, strip, total
from tabulora.plans import rules

KEPT = 5


def page_unit(page: Column) -> Column:
    """The unit that the first 40 lines of a page name, or null."""
    head = F.array_join(F.slice(F.split(page, LINE_END), 1, 40), "\n")
    named = strip(first_match(head, rf"(?U)单位[:：]{SPACE}*([^\n]{{1,30}})"))
    return F.coalesce(
        F.nullif(named, F.lit("")),
        F.when(F.contains(head, F.lit("人民币百万元")), "人民币百万元").when(F.contains(head, F.lit("单位：万元")), "万元").when(F.contains(head, F.lit("单位：亿元")), "亿元").when(F.contains(head, F.lit("单位：元")), "元"),
    )


def line_score(metric: Column, line: Column, page: Column, term: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, rf"(?U){SPACE}+", "")
    n, at = F.size(numbers.plain_tokens(line)), F.position(bare(term), bare(line))
    flow, stock = metric.isin("revenue", "net_profit_attributable", "operating_cash_flow", "eps_basic"), metric.isin("total_assets", "total_liabilities", "equity_attributable")
    profit = metric == "net_profit"
    return total(
        [
            (page <= 3, 2.0), ((page > 3) & (page <= 6), 0.8), (has_any(line, rules.SUMMARY), 4.0),
            (has_any(line, ["合并资产负债表", "合并利润表", "合并现金流量表"]), 1.2),
            (has_any(line, ["本报告期末", "报告期末", "2026年1-3月", "2026 年 1-3 月"]), 1.0),
            (has_any(line, ["单位", "人民币百万元"]), 0.5), (at == 1, 1.5), (at.between(2, 7), 0.8),
            (profit & has_any(line, rules._SEED_PROFIT), -5.0), (profit & has_any(line, ["持续经营净利润"]), -0.4),
            (flow & (n >= 3), 0.6), (stock & (n >= 2), 0.4), (n <= 1, -2.0),
        ]
    )


def candidates(pages: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best `kept` candidates of each metric of each document of pages (doc_id, page, text)."""
    every = F.filter(F.transform(F.split("text", LINE_END), lambda x: F.regexp_replace(x, rf"(?U){SPACE}+$", "")), lambda x: x != "")
    rows = pages.withColumn("unit", page_unit(F.col("text"))).select("doc_id", "page", "unit", F.posexplode(every).alias("k", "line"))
    after = F.lead("line").over(Window.partitionBy("doc_id", "page").orderBy("k"))
    rows = rows.withColumn("_b", strip(F.concat("line", F.lit(" "), after)))
    rows = rows.withColumn("anchor", F.col("line")).withColumn("_m", F.explode(F.filter(F.array("line", "_b"), lambda x: x.isNotNull()))).drop("line", "_b").withColumnRenamed("_m", "line")
    rules_of = F.array(*[F.struct(F.lit(key).alias("metric"), F.array(*[F.lit(t) for t in terms]).alias("terms"), F.array(*[F.lit(x) for x in no]).cast("array<string>").alias("no")) for key, terms, no in rules.SEED])
    fits = F.filter(rules_of, lambda r: F.exists(r.terms, lambda t: F.contains("line", t)) & ~F.exists(r.no, lambda x: F.contains("line", x)))
    rows = rows.where(F.col("line").rlike("[0-9]")).withColumn("_r", F.explode(fits)).select("*", "_r.metric", "_r.terms").drop("_r")
    compact = strip("line")
    rows = rows.withColumn("_v", F.transform("terms", lambda t: F.when(F.contains("line", t), F.struct(t.alias("term"), _value(F.col("metric"), compact, t).alias("value")))))
    rows = rows.withColumn("_c", F.try_element_at(F.filter("_v", lambda v: v.isNotNull() & v.value.isNotNull()), F.lit(1))).where("_c is not null")
    rows = rows.select("doc_id", "metric", "page", "_c.term", strip("line").alias("line"), strip("anchor").alias("anchor_line"), "_c.value", "unit", F.col("line").alias("_l"))
    rows = rows.withColumn("score", F.round(line_score(F.col("metric"), F.col("_l"), F.col("page"), F.col("term")), 2)).withColumn("numeric_value", F.regexp_replace("value", ",", "").try_cast("double"))
    amount = F.when(F.col("metric") != "eps_basic", F.round(F.col("numeric_value") * numbers.multiplier("unit", None), 4))
    order = Window.partitionBy("doc_id", "metric").orderBy(F.col("score").desc(), "page", "line")
    return rows.withColumn("normalized_value_cny", amount).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).drop("_l")


def _value(metric: Column, line: Column, term: Column) -> Column:
    at = F.position(term, line)
    tail = F.when(at > 0, F.substring(line, at + F.length(term), F.lit(1 << 30))).otherwise(line)
    found = numbers.plain_tokens(tail)
    noted = metric.isin("eps_basic", "operating_cash_flow")
    return F.try_element_at(F.when(noted, numbers.without_leading_digit(found)).otherwise(found), F.lit(1))


def seed_cases(best: DataFrame) -> DataFrame:
    """(doc_id, expected_metrics) as a map of the first candidates."""
    one = F.struct("metric", F.struct("value", F.col("unit").alias("expected_unit"), F.col("numeric_value").alias("expected_numeric_value"), F.col("normalized_value_cny").alias("expected_normalized_value_cny")).alias("m"))
    return best.where("rank = 1").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("expected_metrics"))


def corrected(gold: DataFrame, patches: DataFrame) -> DataFrame:
    """gold (doc_id, metric, value, …) with the values of patches (doc_id, metric, value, …) where they have any."""
    fields = [c for c in gold.columns if c not in ("doc_id", "metric")]
    p = patches.select("doc_id", "metric", *[F.col(c).alias(f"_{c}") for c in fields if c in patches.columns])
    rows = gold.join(p, ["doc_id", "metric"], "left")
    return rows.select("doc_id", "metric", *[F.coalesce(f"_{c}", c).alias(c) if c in patches.columns else F.col(c) for c in fields])


def long_rows(best: DataFrame, documents: DataFrame) -> DataFrame:
    """The first candidate of each metric as a row for people to look through: document_title, metric, value, unit,
    normalized_value_cny, page, term, score, line."""
    rows = best.where("rank = 1").join(documents.select("doc_id", F.col("title").alias("document_title")), "doc_id")
    return rows.select("document_title", "metric", "value", "unit", "normalized_value_cny", "page", "term", "score", "line")


def fact_cases(best: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_title, expected_report_period, expected_metrics): every document as a case, without metrics if none was
    found."""
    rows = documents.select("doc_id", F.col("title").alias("document_title"), period("title", "source")[0].alias("expected_report_period"))
    return rows.join(seed_cases(best), "doc_id", "left").drop("doc_id")
