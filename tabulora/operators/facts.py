"""Scored facts of reports: candidate lines, scores, the best candidate, balance-sheet checks, ratios and signals.

Lines have (doc_id, stream, line_seq, text, mode, chunk_type, page_number, section_title, table_title); documents have
(doc_id, title, source, company, ticker, industry, published_at, raw_text). All metrics of all documents are one plan:
lines meet the terms by containment of a short fixed list, which is an explode of a constant, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.functions import numbers
from tabulora.functions.metadata import currency_and_unit, period
from tabulora.functions.text import SPACE, has_any, join_parts, lines, settle, squeeze, total
from tabulora.plans import rules

THRESHOLD, LOW, DERIVED = 0.8, 0.49, 0.88
MONEY_FLOW, BALANCE = ["revenue", "net_profit", "net_profit_attributable"], ["total_assets", "total_liabilities", "equity_attributable"]


# ---------------------------------------------------------------- lines
def layout_lines(pages: DataFrame, longest: int = 180) -> DataFrame:
    """(doc_id, page_number, line_seq, text) of page lines (doc_id, page, seq, text): each line, then it and the next."""
    rows = pages.withColumn("text", F.regexp_replace("text", rf"(?U)^{SPACE}+|{SPACE}+$", "")).where("text <> ''")
    rows = rows.withColumn("_after", F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("seq")))
    both = F.concat(F.col("text"), F.lit(" "), F.col("_after"))
    made = F.filter(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), both.alias("t"))), lambda x: x.t.isNotNull() & ((x.k == 0) | (F.length(x.t) <= longest)))
    rows = rows.select("doc_id", F.col("page").alias("page_number"), "seq", F.explode(made).alias("m"))
    return rows.select("doc_id", "page_number", (F.col("seq") * 2 + F.col("m.k")).alias("line_seq"), F.col("m.t").alias("text"))


def candidate_lines(documents: DataFrame, chunks: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """The three streams of lines: passages by index, the raw text, the layout of pages."""
    none = F.lit(None).cast("string")
    raw = chunks.select("doc_id", "chunk_index", "chunk_type", "page_number", "section_title", "table_title", F.posexplode(lines("content")).alias("k", "text"))
    out = raw.select("doc_id", F.lit(0).alias("stream"), F.struct(F.lit(0).alias("page"), F.col("chunk_index").cast("long").alias("a"), F.col("k").cast("long").alias("b")).alias("line_seq"), "text", F.lit("raw").alias("mode"), "chunk_type", F.col("page_number").cast("int").alias("page_number"), "section_title", "table_title")
    text = documents.select("doc_id", F.posexplode(lines("raw_text")).alias("k", "text"))
    seq = lambda page, a: F.struct(page.cast("int").alias("page"), a.cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("line_seq")
    out = out.unionByName(text.select("doc_id", F.lit(1).alias("stream"), seq(F.lit(0), F.col("k")), "text", F.lit("raw_text").alias("mode"), F.lit("text").alias("chunk_type"), F.lit(None).cast("int").alias("page_number"), F.lit("raw_text").alias("section_title"), none.alias("table_title")))
    if layout is not None:
        out = out.unionByName(layout.select("doc_id", F.lit(2).alias("stream"), seq(F.col("page_number"), F.col("line_seq")), "text", F.lit("pdf_layout").alias("mode"), F.lit("pdf_layout").alias("chunk_type"), F.col("page_number").cast("int").alias("page_number"), F.lit("pdf_layout").alias("section_title"), none.alias("table_title")))
    return out


# ---------------------------------------------------------------- candidates
def _terms() -> Column:
    """Every (metric, term) as a constant array of structs, in order."""
    made = []
    for k, (key, _, terms, scope, amount, unit, _, _) in enumerate(rules.METRICS):
        for j, term in enumerate(terms):
            made.append(F.struct(F.lit(k).alias("m"), F.lit(key).alias("metric"), F.lit(j).alias("j"), F.lit(term).alias("term"), F.lit(scope).alias("scope"), F.lit(amount).alias("amount"), F.lit(unit).cast("string").alias("unit")))
    return F.array(*made)


def matches_term(flat: Column, term: Column) -> Column:
    """Whether a line without white space states the term, rather than a share or part of it."""
    revenue = (term == "营业收入") & has_any(flat, rules.NOT_REVENUE)
    profit = (term == "净利润") & has_any(flat, rules.NOT_NET_PROFIT)
    return F.contains(flat, term) & ~revenue & ~profit


def term_start(text: Column, flat: Column, term: Column) -> Column:
    """The place (from 1) at which the term begins in the line, white space inside it allowed."""
    direct = F.position(term, text)
    ahead = F.position(term, flat) - 1
    spaced = F.array_join(F.transform(F.split(term, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), rf"{SPACE}*")
    return F.when(direct > 0, direct).when(ahead >= 0, F.regexp_instr(text, F.concat(F.lit("(?Ui)"), spaced)))


def is_statement_row(text: Column, flat: Column, term: Column) -> Column:
    """A line of a statement: the term near its start, two numbers, and cells, gaps, a term or a numeral at the front."""
    at = F.position(term, flat)
    front = F.contains(text, F.lit("|")) | text.rlike(rf"(?U){SPACE}{{2,}}") | F.startswith(flat, term) | F.contains(F.substring(text, 1, 8), F.lit("、"))
    return at.between(1, 13) & (F.length(text) <= 140) & (F.size(numbers.tokens(text)) >= 2) & front


def candidate_score() -> Column:
    """Additive score of a candidate (metric, term, scope, text, flat, combined, mode, chunk_type, page_number)."""
    key, term, text, flat, all_of = (F.col(c) for c in ("metric", "term", "text", "flat", "combined"))
    page, mode = F.col("page_number"), F.col("mode")
    first, at = F.startswith(flat, term), F.position(term, flat)
    profit, revenue, eps = key == "net_profit", key == "revenue", key == "eps_basic"
    early = F.coalesce(page, F.lit(0)).between(1, 3)
    noted = F.contains(text, F.concat(term, F.lit("("))) | F.contains(text, F.concat(term, F.lit("（")))
    statement = (key.isin(MONEY_FLOW) & has_any(all_of, ["利润表"])) | (key.isin(BALANCE) & has_any(all_of, ["资产负债表"])) | ((key == "operating_cash_flow") & has_any(all_of, ["现金流量表"]))
    table: list[tuple[Column, float]] = [
        (F.col("chunk_type") == "table", 1.2),
        (early, 0.6),
        (mode == "raw", 1.5),
        (mode == "raw_text", 3.0),
        (mode == "pdf_layout", 4.0),
        (has_any(all_of, rules.SUMMARY), 3.2),
        (has_any(all_of, ["变动情况", "变动的情况", "主要原因", "变动比例"]), -2.6),
        (first, 1.6),
        (at.between(1, 7), 0.8),
        ((mode == "pdf_layout") & first, 2.2),
        (~eps & (page <= 3) & noted, -4.0),
        ((F.col("scope") == "current_period") & has_any(all_of, ["本报告期"]), 1.0),
        ((F.col("scope") == "period_end") & has_any(all_of, ["本报告期末", "上年度末", "期末"]), 1.2),
        ((F.col("scope") == "period_end") & has_any(all_of, ["资产负债表"]), 0.6),
        (statement, 4.2),
        (revenue & has_any(all_of, ["其中营业收入"]), -0.3),
        (revenue & has_any(all_of, rules.SHARE_OF_REVENUE), -4.0),
        (profit & has_any(all_of, ["归属于上市公司股东的净利润"]), -0.4),
        (profit & has_any(all_of, ["扣除非经常性损益"]), -4.0),
        (profit & has_any(flat, ["五、净利润", "四、净利润", "净利润（", "净利润("]), 5.0),
        (profit & F.startswith(flat, F.lit("净利润")), 4.0),
        (profit & has_any(flat, ["归属于"]), -4.0),
        (eps & (F.size(numbers.plain_tokens(text)) <= 1), -2.5),
    ]
    for name, _, _, _, _, _, good, bad in rules.METRICS:
        table += [((key == name) & F.contains(all_of, F.lit(g)), 1.0) for g in good]
        table += [((key == name) & F.contains(all_of, F.lit(b)), -2.0) for b in bad]
    return total(table)


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.35), 0.45 + score / 10)), 4)


def candidates(every_line: DataFrame, infos: DataFrame) -> DataFrame:
    """Scored facts of each line that states a term with at least two numbers. infos: (doc_id, title, currency, unit)."""
    rows = every_line.where(F.col("text").rlike("[0-9]"))
    rows = settle(rows, flat=squeeze("text"))
    # of the terms only those that the line states are carried on
    rows = rows.withColumn("_t", F.explode(F.filter(_terms(), lambda t: matches_term(F.col("flat"), t.term)))).select("*", "_t.*").drop("_t")
    bar, eps = F.contains("text", F.lit("|")), F.col("metric") == "eps_basic"
    gate = ~(eps & ~bar & (F.col("mode") != "raw_text")) & ~(F.col("amount") & ~bar & (F.col("mode") == "raw"))
    rows = rows.where(gate).where((F.col("mode") != "raw_text") | is_statement_row(F.col("text"), F.col("flat"), F.col("term")))
    rows = settle(rows, start=term_start(F.col("text"), F.col("flat"), F.col("term"))).where("start is not null")
    rows = settle(rows, source=F.substring(F.col("text"), F.col("start"), F.lit(1 << 30)))
    rows = settle(rows, values=numbers.tokens("source")).where("size(values) > 0")
    rows = settle(rows, values=numbers.without_footnote("source", "values"))
    rows = settle(rows, values=F.when(F.col("metric") == "eps_basic", numbers.without_eps_footnote("source", F.col("term"), "values")).otherwise(F.col("values"))).where("size(values) >= 2")
    rows = settle(rows, value=F.element_at("values", 1), previous_value=F.element_at("values", 2), change_pct=numbers.change(F.slice("values", 3, 1 << 20)))
    rows = settle(rows, numeric_value=numbers.value("value")).where("numeric_value is not null")
    # the longest text of a candidate is made of those that are left
    rows = settle(rows, combined=squeeze(join_parts([F.col("section_title"), F.col("table_title"), F.col("text")])))
    rows = settle(rows, score=F.round(candidate_score(), 6)).join(infos.select("doc_id", "title", "currency", F.col("unit").alias("doc_unit")), "doc_id")
    name = F.element_at(F.create_map(*[F.lit(x) for m in rules.METRICS for x in m[:2]]), F.col("metric"))
    amount = F.when(F.col("amount"), F.round(F.col("numeric_value") * numbers.multiplier("doc_unit"), 4))
    return rows.select(
        "doc_id", "metric", F.col("m").alias("ord"), name.alias("display_name"), F.lit("raw_extracted").alias("fact_origin"), "term", "value", "numeric_value", "previous_value",
        numbers.value("previous_value").alias("previous_numeric_value"), "change_pct", F.coalesce("unit", "doc_unit").alias("reported_unit"), "currency", amount.alias("normalized_value_cny"),
        "scope", F.col("page_number").alias("source_page"), F.col("title").alias("citation_title"), "section_title", "table_title", confidence(F.col("score")).alias("confidence"),
        "score", "stream", "line_seq", "j",
    )


def best_facts(scored: DataFrame) -> DataFrame:
    """The candidate with the highest score of each metric of each document; of equals the first line and term."""
    order = Window.partitionBy("doc_id", "metric").orderBy(F.col("score").desc(), "stream", "line_seq", "j")
    rows = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.drop("_n", "score", "stream", "line_seq", "j").withColumn("quality_flag", F.lit(None).cast("string")).withColumn("consistency_gap", F.lit(None).cast("double"))


# ---------------------------------------------------------------- consistency
def amount(f: str | Column = "") -> Column:
    get = (lambda c: F.col(f"{f}{c}")) if isinstance(f, str) else (lambda c: f[c])
    return F.coalesce(get("normalized_value_cny"), get("numeric_value"))


def is_summary(f: Column) -> Column:
    section, table = squeeze(F.coalesce(f["section_title"], F.lit(""))), squeeze(F.coalesce(f["table_title"], F.lit("")))
    return F.coalesce(f["source_page"] <= 3, F.lit(False)) & (has_any(section, rules.SUMMARY) | has_any(table, rules.SUMMARY))


def consistent(facts: DataFrame) -> DataFrame:
    """Facts after the balance-sheet checks: liabilities far above assets are derived from assets and equity where both
    come from a summary; what still does not add up loses its confidence."""
    cols = facts.columns
    sheet = facts.where(F.col("metric").isin(BALANCE)).withColumn("_f", F.struct(*cols))
    of = lambda k: F.max(F.when(F.col("metric") == k, F.col("_f")))
    wide = sheet.groupBy("doc_id").agg(of("total_assets").alias("a_"), of("total_liabilities").alias("l_"), of("equity_attributable").alias("e_"))
    a, debt, e = amount(F.col("a_")), amount(F.col("l_")), amount(F.col("e_"))
    has = F.coalesce(a != 0, F.lit(False))
    derive = F.coalesce(has & (debt > a * 1.2) & e.isNotNull() & is_summary(F.col("a_")) & is_summary(F.col("e_")), F.lit(False))
    wide = wide.withColumn("derive", derive).withColumn("a", a).withColumn("e", e).withColumn("debt", F.when(derive, F.greatest(a - e, F.lit(0.0))).otherwise(debt)).withColumn("has", has)
    over = F.coalesce(F.col("has") & (F.col("debt") > F.col("a") * 1.2), F.lit(False))
    gap = F.abs(F.col("debt") + F.col("e") - F.col("a")) / F.greatest("a", F.lit(1.0))
    wide = wide.withColumn("over", F.when(over, F.abs(F.col("debt") - F.col("a")) / F.greatest("a", F.lit(1.0)))).withColumn("gap", F.when(F.col("has") & (gap > 0.35), gap))
    state = wide.select("doc_id", "derive", F.col("debt").alias("_debt"), "over", "gap", F.col("a_").alias("base"))
    rows = facts.join(state, "doc_id", "left").withColumn("_made", F.coalesce((F.col("metric") == "total_liabilities") & F.col("derive"), F.lit(False)))
    worth = F.col("_debt") / numbers.multiplier(F.col("base.reported_unit"))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    made = {
        "display_name": F.lit("总负债"), "fact_origin": F.lit("derived"), "term": F.lit("derived"), "value": numbers.formatted(worth), "numeric_value": worth, "previous_value": none_s,
        "previous_numeric_value": none_d, "change_pct": none_d, "normalized_value_cny": F.round("_debt", 4), "confidence": F.lit(DERIVED), "quality_flag": F.lit("derived_from_assets_minus_equity"),
        **{c: F.col(f"base.{c}") for c in ("reported_unit", "currency", "scope", "source_page", "citation_title", "section_title", "table_title")},
    }
    rows = rows.select(*[F.when(F.col("_made"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in cols], "over", "gap")
    flagged_gap = F.col("metric").isin("total_liabilities", "equity_attributable") & F.col("gap").isNotNull()
    flagged_over = (F.col("metric") == "total_liabilities") & F.col("over").isNotNull()
    down = flagged_gap | flagged_over
    rows = rows.withColumn("fact_origin", F.when(down & (F.col("fact_origin") == "raw_extracted"), "downgraded_raw").otherwise(F.col("fact_origin")))
    rows = rows.withColumn("confidence", F.when(down, F.round(F.least("confidence", F.lit(LOW)), 4)).otherwise(F.col("confidence")))
    rows = rows.withColumn("quality_flag", F.when(flagged_gap, "balance_sheet_gap").when(flagged_over, "balance_sheet_inconsistent").otherwise(F.col("quality_flag")))
    rows = rows.withColumn("consistency_gap", F.when(flagged_gap, F.round("gap", 6)).when(flagged_over, F.round("over", 6)).otherwise(F.col("consistency_gap")))
    return rows.select(*cols)


# ---------------------------------------------------------------- analysis
def _sorted(keys: Column) -> Column:
    return F.array_sort(F.collect_list(keys))


def analysis(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document ratios, signals, usable and excluded metrics and a summary; documents without facts included."""
    good = F.col("confidence") >= THRESHOLD
    of = lambda k: F.max(F.when(good & (F.col("metric") == k), amount())).alias(k)
    low = F.when(~good, F.col("metric"))
    grouped = facts.groupBy("doc_id").agg(
        *[of(k) for k in rules.METRIC_KEYS],
        _sorted(F.when(good & (F.col("fact_origin") == "raw_extracted"), F.col("metric"))).alias("raw_metrics"),
        _sorted(F.when(good & (F.col("fact_origin") == "derived"), F.col("metric"))).alias("derived_metrics"),
        _sorted(low).alias("low_confidence_metrics"), F.collect_set("metric").alias("have"), F.count("*").cast("int").alias("available_metric_count"),
    )
    none = F.array().cast("array<string>")
    rows = documents.select("doc_id").join(grouped, "doc_id", "left")
    for c in ("raw_metrics", "derived_metrics", "low_confidence_metrics", "have"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    rows = rows.withColumn("available_metric_count", F.coalesce("available_metric_count", F.lit(0)))
    rows = rows.withColumn("missing_metrics", F.filter(F.array(*[F.lit(k) for k in rules.METRIC_KEYS]), lambda k: ~F.array_contains("have", k)))
    sales, assets = F.nullif("revenue", F.lit(0.0)), F.nullif("total_assets", F.lit(0.0))
    profit = F.coalesce(F.nullif("net_profit_attributable", F.lit(0.0)), "net_profit")
    ratio = {"net_margin": profit / sales, "debt_to_assets": F.col("total_liabilities") / assets, "operating_cashflow_margin": F.col("operating_cash_flow") / sales, "equity_ratio": F.col("equity_attributable") / assets}
    for name, x in ratio.items():
        rows = rows.withColumn(name, x)
    percent = lambda c: F.regexp_replace(F.round(F.col(c) * 100, 2).cast("string"), r"^(-?[0-9]+)$", "$1.0")
    signal = lambda name, c, value, words: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.concat(F.lit(words), percent(c), F.lit("%")).alias("detail")))
    signs = F.array(
        signal("profitability", "net_margin", F.when(profit > 0, "positive").otherwise("negative"), "归母净利率约 "),
        signal("leverage", "debt_to_assets", F.when(F.col("debt_to_assets") >= 0.6, "high").otherwise("moderate"), "资产负债率约 "),
        signal("cashflow", "operating_cashflow_margin", F.when(F.col("operating_cash_flow") > 0, "positive").otherwise("negative"), "经营现金流率约 "),
    )
    rows = rows.withColumn("signals", F.filter(signs, lambda s: s.isNotNull()))
    gone = F.when(F.size("missing_metrics") > 0, F.array(F.concat(F.lit("仍缺少 "), F.size("missing_metrics").cast("string"), F.lit(" 项关键字段："), F.array_join("missing_metrics", ", ")))).otherwise(none)
    weak = F.when(F.size("low_confidence_metrics") > 0, F.array(F.concat(F.lit("以下字段已抽取但未进入分析计算："), F.array_join("low_confidence_metrics", ", ")))).otherwise(none)
    said = F.concat(F.transform("signals", lambda s: s.detail), gone, weak)
    rows = rows.withColumn("summary", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("当前只完成了基础字段归档，尚未形成足够的分析信号。"))))
    return rows.select("doc_id", *[F.round(r, 6).alias(r) for r in ratio], "signals", "raw_metrics", "derived_metrics", F.col("low_confidence_metrics").alias("excluded_metrics"), "available_metric_count", "missing_metrics", "low_confidence_metrics", "summary")


def basic_info(documents: DataFrame) -> DataFrame:
    """The eleven fields of a report's basic information."""
    name, kind = period("title", "source")
    money, unit = currency_and_unit("raw_text")
    day = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    return documents.select("doc_id", "title", "source", "company", "ticker", "industry", day.alias("published_at"), name.alias("report_period"), kind.alias("report_type"), money.alias("currency"), unit.alias("reported_unit"))


def extract(documents: DataFrame, chunks: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Facts (a row for each metric found) of documents, checked for consistency. The best candidates are found once for the
    checks and for what is checked, and written; so are the facts' own further uses spared the search."""
    infos = basic_info(documents).select("doc_id", "title", "currency", F.col("reported_unit").alias("unit"))
    return consistent(cut(best_facts(candidates(candidate_lines(documents, chunks, layout), infos))))


def payloads(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, artifact_type, payload): both artifacts of each document as JSON."""
    info = basic_info(documents)
    fields = [c for c in facts.columns if c not in ("doc_id", "ord")]
    of = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("f")))).alias("fs"))
    both = info.join(of, "doc_id", "left").join(analysis(facts, documents), "doc_id")
    every = F.transform(F.coalesce("fs", F.array().cast(of.schema["fs"].dataType)), lambda x: x.f)
    metrics = F.map_from_entries(F.transform(every, lambda f: F.struct(f.metric, f)))
    derived = F.array_sort(F.transform(F.filter(every, lambda f: f.fact_origin == "derived"), lambda f: f.metric))
    basic = F.struct(*info.columns)
    head = lambda kind: [F.lit(kind).alias("node_type"), F.lit("v1").alias("schema_version"), "doc_id", "company", "ticker", "report_period"]
    facts_json = F.to_json(F.struct(*head("extract_facts"), "report_type", basic.alias("basic_info"), every.alias("facts"), metrics.alias("metrics"), F.struct(F.size(every).alias("fact_count"), "missing_metrics", derived.alias("derived_metrics")).alias("data_quality")))
    ratios = F.struct("net_margin", "debt_to_assets", "operating_cashflow_margin", "equity_ratio")
    quality = F.struct("available_metric_count", "missing_metrics", "low_confidence_metrics", F.lit(THRESHOLD).alias("analysis_confidence_threshold"))
    usable = F.struct("raw_metrics", "derived_metrics", "excluded_metrics")
    analysis_json = F.to_json(F.struct(*head("analyze_fundamentals"), basic.alias("basic_info"), metrics.alias("snapshot"), ratios.alias("ratios"), "signals", usable.alias("usable_for_calc"), quality.alias("data_quality"), "summary"))
    kinds = F.array(F.struct(F.lit("extract_facts").alias("artifact_type"), facts_json.alias("payload")), F.struct(F.lit("analyze_fundamentals").alias("artifact_type"), analysis_json.alias("payload")))
    return both.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.artifact_type", "k.payload")
