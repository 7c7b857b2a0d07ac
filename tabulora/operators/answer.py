"""Answers out of retrieved passages: the metric asked for, the best value, citations, guard and log rows.

Hits are passages with (query_id, rank, score) beside the passage's and its document's fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulora.functions import numbers
from tabulora.functions.text import _col, collapse, has_any, settle, squeeze, total
from tabulora.plans import rules

MIN_SCORE, EVIDENCE, RADIUS, SNIPPET = 0.015, 3, 90, 220


def asked(query) -> Column:
    """(label, terms) of the first metric that the query names, or null."""
    q, out = squeeze(query), None
    for label, terms in rules.ASKED:
        one = F.struct(F.lit(label).alias("label"), F.array(*[F.lit(t) for t in terms]).alias("terms"))
        fits = has_any(q, terms)
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out


def value_confidence(flat: Column, value: Column, label: Column, term: Column) -> Column:
    """Additive score of a number as the value of a term on a line without white space."""
    at, there = F.position(term, flat), F.position(value, flat)
    digits = F.length(F.regexp_replace(F.regexp_replace(value, ",", ""), "^-+", ""))
    return total(
        [
            ((at > 0) & (there > at), 1.0), (F.contains(value, F.lit(",")), 2.0), (F.contains(value, F.lit(".")), 0.4), (digits >= 8, 1.2), (digits.between(5, 7), 0.6),
            (has_any(flat, ["本报告期", "本报告期末", "上年度末", "2026年第一季度", "2026年13月", "2026年3月31日"]), 1.5),
            (has_any(flat, ["本报告期比上年同期", "增减变动幅度"]), 0.5),
            (has_any(flat, ["项目|本报告期", "项目|2026年第一季度", "项目|2026年13月"]), 1.0),
            (has_any(flat, ["变动比例", "主要原因"]), -2.2), (has_any(flat, ["百分点"]), -1.8), (F.startswith(value, F.lit("-")), -1.2),
            ((label == "营业收入") & has_any(flat, ["营业总收入", "其中营业收入", "本报告期", "上年同期"]), 1.0),
            ((label == "总资产") & has_any(flat, ["总资产", "本报告期末", "上年度末", "期末"]), 1.0),
        ]
    )


def source_confidence(label: Column) -> Column:
    """Additive score of a passage as a source for the metric."""
    head = squeeze(F.concat_ws("\n", F.coalesce("section_title", F.lit("")), F.coalesce("table_title", F.lit(""))))
    body = squeeze(F.substring("content", 1, 240))
    sales, assets = label == "营业收入", label == "总资产"
    return total(
        [
            (F.col("chunk_type") == "table", 0.2), (F.coalesce("page_number", F.lit(0)).between(1, 3), 0.4), (has_any(head, rules.SUMMARY), 2.8),
            (has_any(head, ["变动情况", "变动的情况", "主要原因"]), -2.4), (has_any(body, ["变动比例", "主要原因"]), -1.4),
            (sales & has_any(body, ["营业总收入"]), -0.4), (sales & has_any(body, ["其中营业收入"]), -0.2), (sales & has_any(body, ["本报告期"]), 0.6), (sales & has_any(head, ["利润表"]), -0.8),
            (assets & has_any(head, ["资产负债表"]), 0.8), (assets & has_any(body, ["本报告期末", "上年度末", "期末"]), 0.6),
        ]
    )


def evidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The first hits with the label asked for and their snippet, value, confidence and source_confidence.

    Of a metric's terms the one with the most certain value counts, of equals the later snippet; without a term in the
    passage its beginning is the snippet.
    """
    rows = hits.where(F.col("rank") <= EVIDENCE).join(queries.select("query_id", asked("query").alias("_a")), "query_id")
    terms = F.coalesce(F.col("_a.terms"), F.array().cast("array<string>"))
    rows = settle(rows, label=F.col("_a.label"), _terms=terms, _text=collapse("content"))
    rows = settle(rows, _low=F.lower("_text"), _flat=squeeze("_text"), _numbers=numbers.plain_tokens("_text"))

    def of_term(t: Column) -> Column:
        at = F.position(t, F.col("_low"))
        left = F.greatest(at - RADIUS, F.lit(1))
        snippet = F.substring(F.trim(F.substring(F.col("_text"), left, at - 1 + RADIUS - (left - 1)), F.lit(" |")), 1, SNIPPET)
        # numbers in order; the first of the best counts, and none that scores nothing
        scored = F.transform("_numbers", lambda v, i: F.struct(value_confidence(F.col("_flat"), v, F.coalesce("label", F.lit("")), t).alias("s"), (-i).alias("i"), v.alias("v")))
        best = F.array_max(F.filter(scored, lambda x: (x.s > 0) & F.contains(F.col("_flat"), t)))
        return F.when(at > 0, F.struct(F.coalesce(best.s, F.lit(0.0)).alias("confidence"), snippet.alias("snippet"), best.v.alias("value")))

    rows = settle(rows, _f=F.array_max(F.filter(F.transform("_terms", of_term), lambda x: x.isNotNull())))
    return rows.select(
        "query_id", "rank", "chunk_id", "title", "label", F.coalesce("_f.snippet", F.substring("_text", 1, SNIPPET)).alias("snippet"), F.col("_f.value").alias("value"),
        F.coalesce("_f.confidence", F.lit(0.0)).alias("confidence"), source_confidence(F.coalesce("label", F.lit(""))).alias("source_confidence"),
    )


def summaries(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer) from evidence: the best value with its source, and the snippets."""
    best = F.max(F.when(F.col("value").isNotNull(), F.struct((F.round(F.col("confidence") + F.col("source_confidence"), 9)).alias("total"), "source_confidence", "confidence", "value", (-F.col("rank")).alias("r")))).alias("b")
    said = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- ["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), "snippet").alias("s"))))
    rows = queries.join(found.groupBy("query_id").agg(best, F.transform(said, lambda x: x.s).alias("said"), F.first("label").alias("label")), "query_id")
    known = F.concat(F.lit("结论：根据["), (-F.col("b.r")).cast("string"), F.lit("]，"), "label", F.lit("为 "), "b.value", F.lit("。"))
    open_ = F.concat(F.lit("结论：已基于检索到的文档为问题“"), "query", F.lit("”整理出候选证据。"))
    note = F.lit("说明：当前未配置可用的 LLM 接口，返回的是证据摘要而不是模型生成答案。")
    head = F.when(F.col("label").isNotNull() & F.col("b").isNotNull(), known).otherwise(open_)
    return rows.select("query_id", F.array_join(F.concat(F.array(head, F.lit("依据：")), "said", F.array(note)), "\n").alias("answer"))


def citations(hits: DataFrame, most: int) -> DataFrame:
    """(query_id, citations): the first hits as they are cited."""
    fields = ["doc_id", "title", "source", "doc_type", "chunk_type", "section_title", "page_number", "table_title", "figure_title", "published_at"]
    have = [F.col(c) if c in hits.columns else F.lit(None).cast("string").alias(c) for c in fields]
    one = F.struct("rank", F.struct(*have, F.substring("content", 1, 240).alias("snippet"), F.round("score", 4).alias("score")).alias("c"))
    return hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.c).alias("citations"))


def context(hits: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, context): evidence blocks for a prompt."""
    unknown = lambda c: F.coalesce(F.nullif(_col(c).cast("string"), F.lit("")), F.lit("unknown"))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    block = F.array_join(
        F.array(
            F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit(""))), line("page", unknown(F.nullif(F.col("page_number"), F.lit(0)))), line("chunk_type", F.col("chunk_type")),
            line("section", unknown("section_title")), line("table", unknown("table_title")), line("source", F.coalesce("source", F.lit(""))), line("score", F.format_string("%.6f", "score")), line("content", F.substring("content", 1, 600)),
        ), "\n",
    )
    rows = hits.where(F.col("rank") <= most)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"))


def messages(query: Column, evidence_text: Column) -> Column:
    """System and user message for a model that may only use the evidence."""
    system = F.lit("你是一个投研知识助手。只能基于给定证据回答，不允许补充证据中没有出现的事实。如果证据不足，要明确说证据不足。回答尽量简洁，使用中文。优先输出“结论：”“依据：”“来源：”三部分。")
    user = F.concat(F.lit("问题："), query, F.lit("\n\n证据：\n"), evidence_text, F.lit("\n\n请只基于上述证据回答。来源请引用证据编号，如[1][2]。"))
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", system), one("user", user))


def answer(queries: DataFrame, hits: DataFrame, top_k: int = 5, least: float = MIN_SCORE) -> DataFrame:
    """(query_id, query, answer, citations, guard_passed, refusal_reason, answer_mode) of each query."""
    top = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    rows = queries.join(top, "query_id", "left").join(summaries(evidence(hits, queries), queries), "query_id", "left").join(citations(hits, top_k), "query_id", "left")
    guard = F.coalesce(F.col("top") >= least, F.lit(False))
    known = asked("query").isNotNull()
    text = F.when(guard & known, F.col("answer")).when(guard, rules.UNSUPPORTED).otherwise(rules.REFUSAL)
    reason = F.when(guard & ~known, "unsupported_query_without_llm").when(~guard, "insufficient_evidence")
    # an answer about an unsupported question is logged like that of a model
    mode = F.when(~guard, "refusal").when(known, "fallback_summary").otherwise("llm")
    return rows.select("query_id", "query", text.alias("answer"), F.when(guard & known, F.col("citations")).alias("citations"), guard.alias("guard_passed"), reason.alias("refusal_reason"), mode.alias("answer_mode"))


def log_rows(answers: DataFrame, hits: DataFrame, top_k: int, tag: str = "interactive") -> DataFrame:
    """Rows for the query log: query, rewritten query, answer, sources as JSON with at most eight hits."""
    one = F.struct("rank", F.struct("chunk_id", "doc_id", "score", "reasons").alias("h"))
    kept = hits.where("rank <= 8").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.h).alias("retrieval_hits"))
    rows = answers.join(kept, "query_id", "left")
    sources = F.to_json(F.struct(F.lit(tag).alias("request_tag"), F.lit(top_k).alias("top_k"), "guard_passed", "refusal_reason", "answer_mode", "citations", "retrieval_hits"))
    return rows.select("query_id", "query", collapse("query").alias("rewritten_query"), "answer", sources.alias("sources"))
