"""Operators over reports: layout, passages, retrieval, facts, answers, store, evaluation, sources, streaming."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulora.operators import answer, chunk, clean, evaluate, facts, goldseed, layout, retrieve, store
from tabulora.plans import fixtures
from tabulora.plans.queries import QUERIES
from tabulora.sources import files, tables
from tests.test_functions import one


# ---------------------------------------------------------------- layout
def test_glued_lines_take_pairs_from_the_top(spark):
    texts = ["一、", "二、", "三、", "正文", "四、", "x" * 41, "五、"]
    rows = spark.createDataFrame([(1, 1, float(k), k, t) for k, t in enumerate(texts)], "doc_id int, page int, y double, seq int, text string")
    got = [r.text for r in clean.glued_lines(rows).orderBy("seq").collect()]
    assert got == ["一、二、", "三、正文", "四、", "x" * 41, "五、"]


def test_page_layout(spark):
    got = {(r.doc_id, r.page): r for r in QUERIES["page_layout"](spark, "").collect()}
    assert (got[1, 1].section, got[1, 1].tail, got[1, 1].captions) == ("一、主要会计数据", "二、重要事项", "收入构成情况如下")
    assert (got[1, 2].section, got[1, 2].tail) == ("三、财务报告", "三、财务报告")


def test_titles_and_images(spark):
    title = lambda *a: one(spark, layout.table_title(*[F.lit(x) for x in a]))
    assert title("表 1 收入明细表", None, None, None, 1, 1, 200.0) == "表 1 收入明细表"
    assert title(None, "单位：元", "项目", "重要事项", 3, 2, 200.0) == "重要事项 第3页表2"
    assert title(None, None, None, None, 3, 2, 100.0) == "" and title(None, None, None, None, 3, 2, 111.0) == "第3页表2"
    rows = spark.createDataFrame([(1, 1, [[" a ", None], [None, " "], ["b", "c"]])], "doc_id int, page int, rows array<array<string>>")
    assert rows.select(layout.table_text("rows")).first()[0] == "a | \nb | c"
    assert one(spark, layout.inferred_title(F.lit(" 营业收入构成表 | x\ny"))) == "营业收入构成表" and one(spark, layout.inferred_title(F.lit(""))) == ""
    lines_ = spark.createDataFrame([(1, 1, 0, 1.0, "图 1 甲"), (1, 1, 1, 2.0, "正文")], "doc_id int, page int, seq int, y double, text string")
    images = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 1)], "doc_id int, page int, image_idx int")
    got = {(r.page, r.image_idx): (r.content, r.figure_title) for r in layout.image_elements(images, lines_).collect()}
    assert got == {(1, 1): ("图 1 甲", "图 1 甲"), (1, 2): ("图 1 甲", "图 1 甲"), (2, 1): ("Image block detected on page 2.", "Figure 1 on page 2")}
    assert [r.text for r in layout.page_texts(spark.sql(fixtures.BLOCKS), spark.sql(fixtures.TABLES)).orderBy("doc_id", "page").collect()] == ["heading block\npartly", "free", "no tables"]


# ---------------------------------------------------------------- passages
def packed(units, most, between):
    """Greedy packing in words: a unit joins the last pack if both fit."""
    out = []
    for t, hard in units:
        if out and not hard and not out[-1][1] and len(out[-1][0] + between + t) <= most:
            out[-1] = (out[-1][0] + between + t, False)
        else:
            out.append((t, hard))
    return [t for t, _ in out]


def units_of(text, most):
    p = " ".join(text.split())
    if not p or len(p) <= most:
        return [p] if p else []
    cut = lambda s, marks: [x.strip() for x in re.findall(rf"[^{marks}]*[{marks}]\s*|[^{marks}]+$", s) if x.strip()]
    sentences = []
    for s in cut(p, "。！？；;"):
        if len(s) <= most:
            sentences.append((s, False))
            continue
        clauses = []
        for c in cut(s, "，、：:,"):
            clauses += [(c, False)] if len(c) <= most else [(c[k : k + most], True) for k in range(0, len(c), most)]
        sentences += [(x, True) for x in packed(clauses, most, "")]
    return packed(sentences, most, " ")


def test_text_units(spark):
    r = random.Random(8)
    texts = ["", "短。", "句子。" * 300, "很长，" * 400, "x" * 1300, "甲；乙" * 200 + "，" + "y" * 900 + "。尾"]
    texts += ["".join(r.choice(["。", "，", "；", "abc ", "词", "长" * 60, "z" * 430]) for _ in range(r.randint(5, 80))) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in rows.select("id", chunk.text_units("t", F.lit(420)).alias("u")).collect():
        assert row.u == units_of(texts[row.id], 420), row.id
        assert all(len(u) <= 420 for u in row.u)


def elements(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "doc_id long, element_seq int, element_type string, content string, page_number int, section_title string, table_title string, figure_title string")


def test_split_elements(spark):
    big = "\n".join(["项目 | 本期 | 上期", "单位 | 元 | 元", *[f"行{k} | {k} | {k}" for k in range(30)]])
    got = chunk.split_elements(
        elements(spark, [
            ("text", "甲" * 300, 1, "A", None, None), ("text", "乙" * 100, 2, None, None, None), ("text", "丙" * 100, 3, "B", None, None), ("text", "丁" * 400, 4, None, None, None), ("text", "  ", 4, None, None, None),
            ("table", big, 5, "B", "明细", None), ("image", "图 1", 6, "B", None, "图 1"), ("text", "否", 7, "公司是否存在风险", None, None), ("table", "资产总计 | 1\n负债合计 | 2", 8, None, None, None),
        ])
    ).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) == list(range(10))
    assert [(r.chunk_type, r.section_title, r.page_number) for r in got[:3]] == [("text", "A", 1), ("text", "B", 1), ("text", "B", 4)]
    # a title stands before the text where the text has no stop and is short; these are long
    assert got[0].content == "甲" * 300 + "\n" + "乙" * 100 and got[1].content == "丙" * 100 and got[2].content == "丁" * 400
    assert got[3].content.startswith("明细\n项目 | 本期 | 上期\n单位 | 元 | 元\n行0 |") and got[3].content.endswith("... total_rows=30 grouped_rows_per_chunk=12")
    assert [r.table_title for r in got[3:7]] == ["明细", "明细 行组1", "明细 行组2", "明细 行组3"]
    assert [r.content.count("\n") for r in got[4:7]] == [15 - 1, 15 - 1, 9 - 1]
    assert got[7].chunk_type == "image" and got[8].content == "[第7页]\n公司是否存在风险\n否"
    assert got[9].content == "合并资产负债表\n资产总计 | 1\n负债合计 | 2" and got[9].token_count == len(got[9].content)


def test_packing_of_random_runs(spark):
    r = random.Random(5)
    paragraphs = [("text", "".join(r.choice(["句。", "词", "，"]) for _ in range(r.randint(1, 500))), k, None, None, None) for k in range(1, 30)]
    got = [x.content for x in chunk.split_elements(elements(spark, paragraphs)).orderBy("chunk_index").collect()]
    want = packed([(u, False) for p in paragraphs for u in units_of(p[1], 420)], 420, "\n")
    assert got == want


def test_key_sections_and_headers(spark):
    assert one(spark, chunk.limit_of(F.lit("一、重要提示"))) == 520 and one(spark, chunk.limit_of(F.lit(None).cast("string"))) == 420
    header = lambda *rows: one(spark, chunk.header_size(F.array(*[F.lit(x) for x in rows])))
    assert header("a|b", "c|d") == 1 and header("a|b", "c|d", "e") == 2 and header("a|b|c", "d", "e") == 1


# ---------------------------------------------------------------- retrieval
def test_bm25_within_scopes(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "beta"), (4, ""), (5, "delta alpha")]
    texts = spark.createDataFrame([(i, i, t) for i, t in docs], "chunk_id long, doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "。")], "query_id long, query string")
    scope = spark.createDataFrame([(2, 1), (2, 3), (2, 4)], "query_id long, doc_id long")

    def plain(query, allowed):
        own = [(i, t.split()) for i, t in docs if i in allowed]
        n, full = len(own), [len(t) for _, t in own if t]
        mean, out = sum(full) / max(len(full), 1), {}
        for i, t in own:
            s = 0.0
            for w in dict.fromkeys(query.split()):
                df, tf = sum(w in x for _, x in own), Counter(t)[w]
                if tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
            if s > 0:
                out[i] = s + (query in " ".join(t))
        return out

    got: dict = {}
    for r in retrieve.bm25(asked, texts, 10, scope).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert got == {1: pytest.approx(plain("alpha beta", {1, 2, 3, 4, 5})), 2: pytest.approx(plain("beta", {1, 3, 4}))}


def test_query_filters(spark):
    got = {r.query_id: r for r in QUERIES["query_filters"](spark, "").collect()}
    assert (got[1].company, got[1].title_terms, got[1].report_terms, got[1].docs) == ("贵州茅台", "贵州茅台", "季报,季度报告,q1,一季报,第一季度", "1")
    assert (got[2].company, got[2].docs) == ("招商银行", "2") and (got[3].ticker, got[3].docs) == ("600519", "1")
    assert got[4].docs is None and got[5].docs is None


def test_filters_by_case_and_without_fallback(spark):
    docs = spark.sql(fixtures.REPORTS)
    asked = spark.createDataFrame([(1, "q1"), (2, "600519 2031"), (3, "nothing")], "query_id long, query string")
    meta = retrieve.query_metadata(asked, docs)
    strict, loose = ({(r.query_id, r.doc_id) for r in retrieve.scopes(meta, docs, x).collect()} for x in (False, True))
    assert strict == set() and loose == {(1, 1), (1, 2)}
    assert {r.query_id for r in retrieve.without_scope(meta, retrieve.scopes(meta, docs)).collect()} == {2}


def test_fusion_is_symmetric_and_ties_prefer_later_pages(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, chunk_id long, rank int")
    places = spark.createDataFrame([(i, i, i) for i in range(1, 6)], "chunk_id long, page_number int, chunk_index int")
    ranks = lambda a, b: [(r.chunk_id, round(r.score, 9)) for r in retrieve.fuse(leg(a), leg(b), places, 9).orderBy("rank").collect()]
    assert ranks([1, 2, 3], [3, 4]) == ranks([3, 4], [1, 2, 3])
    assert [i for i, _ in ranks([1, 2], [4, 5])] == [4, 1, 5, 2]
    assert ranks([1], [1]) == [(1, round(2 / 61, 9))]


def test_nearest_skips_other_dimensions(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 1)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<float>")
    got = [(r.query_id, r.chunk_id) for r in retrieve.nearest(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 6), (2, 2)]
    assert retrieve.nearest(q, v, 9, true_cosine=True).where("query_id = 1").count() == 4
    assert retrieve.nearest(q.limit(0), v, 2).count() == 0


def test_reports_are_found_by_intent(spark):
    got: dict = {}
    for r in QUERIES["retrieve_reports"](spark, "").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got[1][0][0] == 11 and got[2][0][0] == 21 and got[3][0][0] == 13 and got[4][0][0] == 31 and got[6][0][0] == 12
    # one hit on rank 1: 1/61, two of three tokens, no section, no boost
    assert got[4] == [(31, pytest.approx(1 / 61 + 1.0, abs=1e-6))]


def test_all_terms_need_every_token(spark):
    texts = spark.createDataFrame([(1, 1, "a1 b2 c3"), (2, 2, "a1")], "chunk_id long, doc_id long, text string")
    asked = spark.createDataFrame([(1, "a1 b2")], "query_id long, query string")
    assert [(r.query_id, r.chunk_id) for r in retrieve.all_terms(asked, texts).collect()] == [(1, 1)]


# ---------------------------------------------------------------- facts
def test_facts_of_reports(spark):
    got = {(r.doc_id, r.metric): r for r in QUERIES["extract_facts"](spark, "").collect()}
    assert {k: r.value for k, r in got.items()} == {
        (1, "revenue"): "5,100.00", (1, "net_profit_attributable"): "1,900.00", (1, "net_profit"): "2,000.00", (1, "total_assets"): "91,000.00", (1, "total_liabilities"): "31,000", (1, "equity_attributable"): "60,000.00",
        (1, "operating_cash_flow"): "(300.00)", (1, "eps_basic"): "1.52", (2, "revenue"): "800", (2, "net_profit_attributable"): "300", (2, "total_assets"): "1,000", (2, "equity_attributable"): "100", (2, "total_liabilities"): "900",
    }
    assert (got[1, "total_liabilities"].fact_origin, got[1, "total_liabilities"].confidence) == ("derived", 0.88)
    assert got[2, "revenue"].normalized_value_cny == 8e8 and got[1, "eps_basic"].normalized_value_cny is None and got[1, "eps_basic"].reported_unit == "元/股"
    assert got[1, "revenue"].change_pct == 27.5 and got[1, "operating_cash_flow"].numeric_value == -300.0
    assert all(0.35 <= r.confidence <= 0.99 for r in got.values())


def test_candidate_scores(spark):
    cols = {"metric": "revenue", "term": "营业收入", "scope": "current_period", "text": "营业收入 | 5 | 4", "flat": "营业收入|5|4", "combined": "主要会计数据营业收入|5|4", "mode": "raw", "chunk_type": "table"}
    score = lambda **x: round(one(spark, facts.candidate_score(), **{**cols, "page_number": 2, **x}), 6)
    # table, early page, passage line, summary, starts with the term, near the start, one context
    assert score() == pytest.approx(1.2 + 0.6 + 1.5 + 3.2 + 1.6 + 0.8 + 1.0)
    assert score(mode="pdf_layout", chunk_type="pdf_layout") == pytest.approx(0.6 + 4.0 + 3.2 + 1.6 + 0.8 + 2.2 + 1.0)
    assert score(text="营业收入（元） | 5 | 4") == pytest.approx(score() - 4.0)
    assert score(combined="主要会计数据变动比例营业收入|5|4") == pytest.approx(score() - 2.6 - 2.0)
    assert score(metric="net_profit", term="净利润", flat="五、净利润|5|4", combined="利润表五、净利润|5|4") == pytest.approx(1.2 + 0.6 + 1.5 + 0.8 + 4.2 + 5.0)
    assert score(metric="eps_basic", term="基本每股收益", text="基本每股收益 | 5", flat="基本每股收益|5", combined="x") == pytest.approx(1.2 + 0.6 + 1.5 + 1.6 + 0.8 - 2.5)


def test_first_of_equal_candidates_wins(spark):
    rows = [(1, "m", 0, s, st, {"page": p, "a": 0, "b": b}, j, f"{p}{b}{j}") for (s, st, p, b, j) in [(2.0, 1, 0, 0, 0), (2.0, 0, 0, 5, 1), (2.0, 0, 0, 5, 0), (1.0, 0, 0, 0, 0)]]
    scored = spark.createDataFrame(rows, "doc_id int, metric string, ord int, score double, stream int, line_seq struct<page:int,a:long,b:long>, j int, value string")
    assert [r.value for r in facts.best_facts(scored).collect()] == ["050"]


def test_term_in_a_spaced_line(spark):
    rows = spark.createDataFrame([("营 业 收 入  5,000 4,000", "营业收入"), ("一、 净利润 5", "净利润")], "text string, term string").withColumn("flat", F.regexp_replace("text", r"\s", ""))
    assert [r[0] for r in rows.select(facts.term_start(F.col("text"), F.col("flat"), F.col("term"))).collect()] == [1, 4]


def test_layout_lines_merge_neighbours(spark):
    rows = spark.createDataFrame([(1, 1, 0, " a "), (1, 1, 1, ""), (1, 1, 2, "b"), (1, 1, 3, "x" * 180), (1, 2, 0, "c")], "doc_id int, page int, seq int, text string")
    got = [(r.page_number, r.text) for r in facts.layout_lines(rows).orderBy("page_number", "line_seq").collect()]
    assert got == [(1, "a"), (1, "a b"), (1, "b"), (1, "x" * 180), (2, "c")]


def test_analysis_of_reports(spark):
    got = {r.doc_id: r for r in QUERIES["report_analysis"](spark, "").collect()}
    assert (got[1].net_margin, got[1].debt_to_assets, got[1].signals) == (0.372549, 0.340659, "profitability=positive,leverage=moderate,cashflow=negative")
    assert got[2].summary == "归母净利率约 37.5%|资产负债率约 90.0%|仍缺少 3 项关键字段：net_profit, operating_cash_flow, eps_basic"
    assert got[3].net_margin is None and got[3].signals == "" and got[3].summary.startswith("仍缺少 8 项")


def test_artifacts_are_json(spark):
    got = {(r.doc_id, r.artifact_type): json.loads(r.payload) for r in QUERIES["artifact_payloads"](spark, "").collect()}
    f, a = got[1, "extract_facts"], got[1, "analyze_fundamentals"]
    assert f["report_period"] == "2026Q1" and f["data_quality"]["fact_count"] == 8 and f["data_quality"]["derived_metrics"] == ["total_liabilities"] and f["metrics"]["revenue"]["value"] == "5,100.00"
    assert a["usable_for_calc"]["derived_metrics"] == ["total_liabilities"] and a["ratios"]["equity_ratio"] == pytest.approx(0.659341) and a["basic_info"]["industry"] == "白酒"
    assert got[3, "extract_facts"]["data_quality"]["fact_count"] == 0


# ---------------------------------------------------------------- gold seed, answers
def test_gold_seed(spark):
    best = {(r.doc_id, r.metric): r for r in QUERIES["gold_seed"](spark, "").where("rank = 1").collect()}
    assert best[1, "revenue"].value == "5,000.00" and best[1, "revenue"].normalized_value_cny == 5000.0 and best[2, "total_liabilities"].normalized_value_cny == 9e8
    assert best[2, "total_assets"].unit is None and best[2, "total_assets"].normalized_value_cny is None
    gold = spark.createDataFrame([(1, "m", "5", 5.0), (1, "n", "6", 6.0)], "doc_id int, metric string, value string, expected_numeric_value double")
    patch = spark.createDataFrame([(1, "n", "7")], "doc_id int, metric string, value string")
    assert sorted((r.metric, r.value, r.expected_numeric_value) for r in goldseed.corrected(gold, patch).collect()) == [("m", "5", 5.0), ("n", "7", 6.0)]
    cases = goldseed.seed_cases(goldseed.candidates(spark.createDataFrame([(1, 1, "单位：万元\n总资产 5,000 4,000")], "doc_id int, page int, text string"))).first()
    assert cases.expected_metrics["total_assets"].asDict() == {"value": "5,000", "expected_unit": "万元", "expected_numeric_value": 5000.0, "expected_normalized_value_cny": 5e7}


def test_answers(spark):
    got = {r.query_id: r for r in QUERIES["answer_questions"](spark, "").collect()}
    assert got[2].answer.startswith("结论：根据[1]，总资产为 1,000。\n依据：\n- [1] 600036_招商银行_2026_Q1报: ") and got[2].answer_mode == "fallback_summary"
    assert got[3].answer.startswith("结论：根据[1]，股票代码为 600519。") and got[6].answer.startswith("结论：根据[1]，总负债为 200,000.00。")
    assert (got[4].refusal_reason, got[4].answer_mode, got[4].n_citations) == ("unsupported_query_without_llm", "llm", 0)
    assert (got[5].refusal_reason, got[5].guard_passed, got[5].answer_mode) == ("insufficient_evidence", False, "refusal") and "没有足够证据" in got[5].answer


def test_value_confidence(spark):
    score = lambda flat, value, label="x", term="总资产": one(spark, answer.value_confidence(F.lit(flat), F.lit(value), F.lit(label), F.lit(term)))
    assert score("总资产5,100.00", "5,100.00") == pytest.approx(1.0 + 2.0 + 0.4 + 0.6)
    assert score("91,000.00总资产", "91,000.00", "总资产") == pytest.approx(2.0 + 0.4 + 1.2 + 1.0)
    assert score("变动比例总资产-5", "-5") == pytest.approx(1.0 - 2.2 - 1.2)


def test_context_log_and_messages(spark):
    _, passages, asked = spark.sql(fixtures.REPORTS), spark.sql(fixtures.PASSAGES), spark.sql(fixtures.QUESTIONS)
    docs = spark.sql(fixtures.REPORTS)
    hits = passages.join(docs, "doc_id").where("chunk_id in (31, 12)").select("*", F.lit(4).cast("long").alias("query_id"), F.row_number().over(__import__("pyspark").sql.Window.orderBy("chunk_id")).alias("rank"), F.lit(0.5).alias("score"), F.array(F.lit("bm25")).alias("reasons"))
    text = answer.context(hits).first().context
    assert text.startswith("[1] 600519_贵州茅台_2026_Q1报\npage: 5\nchunk_type: table\nsection: 合并资产负债表\n") and "\n\n[2] 空白报告\npage: unknown\nchunk_type: text\nsection: unknown" in text and "score: 0.500000" in text
    rows = answer.log_rows(answer.answer(asked.where("query_id = 4"), hits), hits, 5).first()
    sources = json.loads(rows.sources)
    assert sources["request_tag"] == "interactive" and len(sources["retrieval_hits"]) == 2 and rows.rewritten_query == "cash growth"
    m = one(spark, answer.messages(F.lit("q?"), F.lit("E")))
    assert [x.role for x in m] == ["system", "user"] and "问题：q?" in m[1].content


# ---------------------------------------------------------------- store
def test_upsert_is_idempotent(spark):
    old, new = spark.sql(fixtures.OLD), spark.sql(fixtures.NEW)
    first = store.upsert(old, new)
    assert {r.doc_id for r in first.collect()} == {2, 5, 11, 12, 13} == {r.doc_id for r in store.upsert(first, new).collect()}
    assert {r.doc_id for r in store.replaced(old, new).collect()} == {1, 3, 4}
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 1)], "d int, k string, v int")
    assert sorted(store.upsert_by(a, spark.createDataFrame([(1, "x", 2)], a.schema), ["d", "k"]).collect()) == [(1, "x", 2), (1, "y", 1)]
    assert [r.doc_id for r in store.copied(old, new.withColumn("source", F.lit("a"))).orderBy("doc_id").collect()] == [2, 3, 4, 5]


def test_lists_and_targets(spark):
    docs = spark.createDataFrame([(1, "600519", "2026-01-01"), (2, "600519", None), (3, "600519", "2026-01-01")], "doc_id long, ticker string, published_at string")
    got = {r.target: r.doc_id for r in store.resolve(docs, spark.createDataFrame([("600519",), ("2",), ("9",)], "target string")).collect()}
    assert got == {"600519": 3, "2": 2}
    listed = store.document_list(docs, spark.createDataFrame([(1,), (1,)], "doc_id long"), spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "doc_id long, artifact_type string")).collect()
    assert [(r.doc_id, r.chunk_count, r.artifact_types) for r in listed] == [(3, 0, []), (2, 0, []), (1, 2, ["a", "b"])]
    assert [one(spark, store.masked(F.lit(s))) for s in ("", "short", "abcdefghij")] == ["", "*****", "abcd**ghij"]


# ---------------------------------------------------------------- evaluation
def test_parse_and_chunk_cases(spark):
    e = elements(spark, [("text", "alpha", 1, None, None, None), ("table", "t", 1, None, None, None), ("text", "beta", 1, None, None, None)])
    cases = spark.createDataFrame([("a", 1, ["alpha", "beta"], {"text": 2}), ("b", 1, ["gamma"], {}), ("c", 1, None, {"image": 1}), ("d", 9, None, None)], "name string, doc_id long, expected_text_contains array<string>, min_element_counts map<string,int>")
    assert {r.name: r.passed for r in evaluate.parse_cases(cases, e).collect()} == {"a": True, "b": False, "c": False, "d": True}
    chunks = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three")], "doc_id long, chunk_index int, content string")
    cases = spark.createDataFrame([("a", 1, 2, 7, "three"), ("b", 1, 3, 9, None), ("c", 1, 1, 6, None), ("d", 1, 1, 9, "zzz")], "name string, doc_id long, min_chunks int, max_chunk_length int, required_keyword string")
    assert {r.name: r.passed for r in evaluate.chunk_cases(cases, chunks).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_fact_and_answer_cases(spark):
    f = spark.createDataFrame([(1, "m", "5", 0.9, 2, None, "raw_extracted", 5.0, 500.0)], "doc_id int, metric string, value string, confidence double, source_page int, quality_flag string, fact_origin string, numeric_value double, normalized_value_cny double")
    schema = "doc_id int, metric string, value string, min_confidence double, source_page int, quality_flag string, fact_origin string"
    want = [((1, "m", "5", 0.8, None, None, None), True), ((1, "m", "5", 0.95, None, None, None), False), ((1, "m", None, None, 3, None, None), False), ((1, "m", None, None, None, "x", None), False), ((2, "m", None, None, None, None, None), False)]
    for row, passed in want:
        assert [r.passed for r in evaluate.fact_cases(spark.createDataFrame([row], schema), f).collect()] == [passed]
    gold = spark.createDataFrame([(1, "m", "x", None, 500.0), (1, "q", "5", None, None)], "doc_id int, metric string, value string, expected_numeric_value double, expected_normalized_value_cny double")
    fields = evaluate.gold_fields(gold, f)
    assert {r.metric: r.correct for r in fields.collect()} == {"m": True, "q": False} and tuple(evaluate.exact_documents(fields).first()) == (1, 0)
    answers = spark.createDataFrame([(1, "yes 5", [{"title": "A"}]), (2, "没有足够证据", None)], "query_id int, answer string, citations array<struct<title:string>>")
    cases = spark.createDataFrame([(1, ["5"], "A", True), (2, None, None, True), (1, ["6"], None, False), (2, None, "A", False)], "query_id int, expected_answer_contains array<string>, expected_citation_title string, forbid_refusal boolean")
    assert sorted((r.query_id, r.passed) for r in evaluate.answer_cases(cases, answers).collect()) == [(1, False), (1, True), (2, False), (2, False)]
    assert tuple(evaluate.pass_rate(evaluate.answer_cases(cases, answers)).first()) == (4, 1, 0.25)
    assert [one(spark, evaluate.confidence_floor(F.lit(x))) for x in (0.95, 0.8, 0.456, 0.0)] == [0.9, 0.8, 0.45, None]
    assert json.loads(evaluate.expected_facts(f).first().expected_metrics) == {"m": {"value": "5", "min_confidence": 0.9, "source_page": 2, "fact_origin": "raw_extracted"}}


def test_audit(spark):
    docs = spark.sql(fixtures.REPORTS).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    a = facts.analysis(facts.extract(docs, spark.sql(fixtures.PASSAGES)), docs)
    r = evaluate.audit(a, facts.basic_info(docs)).first()
    assert (r.total_documents, r.with_industry, r.documents_with_missing_metrics, r.documents_with_derived_metrics, r.usable_derived) == (3, 2, 2, 1, 1)
    assert {x.doc_id: x.missing_metrics for x in evaluate.audit_csv(a).collect()}[2] == "net_profit | operating_cash_flow | eps_basic"
    n = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],)], "x array<string>")
    assert [(r.name, r.n) for r in evaluate.counters(n, 2, c="x").orderBy(F.desc("n"), "name").collect()] == [("a", 2), ("b", 1)]


def test_open_reviews(spark):
    reviews = spark.createDataFrame([(1, 10, "open"), (2, 10, "resolved"), (3, 11, "open")], "id long, query_log_id long, status string")
    log = spark.createDataFrame([(10, "q", "a"), (11, "r", "b")], "id long, query string, answer string")
    assert [(r.id, r.query) for r in evaluate.open_reviews(reviews, log).collect()] == [(3, "r"), (1, "q")] and evaluate.open_reviews(reviews, log, most=1).count() == 1


# ---------------------------------------------------------------- sources, streaming
def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 标题", encoding="utf-8")
    (tmp_path / "b.HTML").write_text("<p>x</p>")
    (tmp_path / "c").write_bytes(b"ok \xff")
    (tmp_path / "d.pdf").write_bytes(b"line one\nline two")
    got = {r.title: (r.doc_type, r.text) for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a"] == ("md", "# 标题") and got["b"] == ("html", "<p>x</p>") and got["c"][0] == "unknown" and got["c"][1].startswith("ok ") and "d" not in got
    backend = lambda path, raw: ((1, k, float(k), t.decode()) for k, t in enumerate(raw.split(b"\n")))
    assert [r.text for r in files.pdf_lines(spark, backend, f"file://{tmp_path}").orderBy("seq").collect()] == ["line one", "line two"]
    (tmp_path / "list").write_text("# c\n\n 600519 \n")
    assert [r.stock for r in files.stock_list(spark, f"file://{tmp_path}/list").collect()] == ["600519"]
    (tmp_path / "m.json").write_text('{"600519": "白酒"}', encoding="utf-8")
    assert [tuple(r) for r in files.industry_map(spark, f"file://{tmp_path}/m.json").collect()] == [("600519", "白酒")]
    names = spark.createDataFrame([("/x/600519_茅台_2025_Q3报.pdf",), ("/x/600519_茅台_2026_Q1报.pdf",), ("/x/600036_招商_2025_Q1报.pdf",), ("/x/600036_招商_2026_年报.pdf",)], "path string")
    assert {r.code: r.path for r in files.latest_quarterly(names).collect()} == {"600519": "/x/600519_茅台_2026_Q1报.pdf", "600036": "/x/600036_招商_2025_Q1报.pdf"}


def test_versioned_tables(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", "id long, name string")
    assert t.read().count() == 0
    t.append(spark.createDataFrame([(1, "a")], "id long, name string"))
    t.replace(t.read().unionByName(spark.createDataFrame([(2, "b")], "id long, name string")))
    assert t.versions() == [1, 2] and t.read().count() == 2
    tables.write_csv(spark.createDataFrame([(1, ["x", "y"])], "id int, l array<string>"), f"file://{tmp_path}/c")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).first().l == "x | y"


def test_stream_ingests_files_once(spark, tmp_path):
    from tabulora.streaming.ingest import watch

    folder = tmp_path / "in"
    folder.mkdir()
    documents, chunks = tables.Table(spark, f"file://{tmp_path}/d", tables.DOCUMENTS), tables.Table(spark, f"file://{tmp_path}/k", tables.CHUNKS)
    run = lambda: watch(spark, f"file://{folder}", documents, chunks, f"file://{tmp_path}/ck").awaitTermination(120)
    (folder / "600519_贵州茅台_2026_Q1报.txt").write_text("营业收入增长。" * 200, encoding="utf-8")
    run()
    first = documents.read().collect()
    assert [(r.company, r.ticker, r.industry) for r in first] == [("贵州茅台", "600519", "白酒")] and chunks.read().count() == 4
    (folder / "other.txt").write_text("plain")
    run()
    assert documents.read().count() == 2 and chunks.read().count() == 5
    assert all(len(list(g)) for _, g in itertools.groupby(chunks.read().collect(), key=lambda r: r.doc_id))


# ---------------------------------------------------------------- plans
def test_ask_logs_and_artifacts(spark, tmp_path):
    from tabulora.operators import embed
    from tabulora.plans import ask

    docs = spark.sql(fixtures.REPORTS).withColumns({"doc_type": F.lit("pdf"), "published_at": F.lit(None).cast("timestamp_ntz")})
    chunks = spark.sql(fixtures.PASSAGES)
    log, artifacts = tables.Table(spark, f"file://{tmp_path}/log", tables.QUERY_LOGS), tables.Table(spark, f"file://{tmp_path}/art", tables.ARTIFACTS)
    asked = spark.createDataFrame([(2, "招商银行 总资产"), (9, "")], "query_id long, query string")
    vectors = {"vectors": embed.hashed(chunks, "chunk_id", "content", 32), "query_vectors": embed.hashed(asked, "query_id", "query", 32)}
    got = ask.ask(asked, docs, chunks, top_k=2, log=log, **vectors).collect()
    assert [r.query_id for r in got] == [2] and got[0].answer.startswith("结论：根据[1]，总资产为 1,000。") and len(got[0].citations) == 2
    row = log.read().first()
    assert json.loads(row.sources)["top_k"] == 2 and row.query == "招商银行 总资产"
    with pytest.raises(ValueError, match="top_k"):
        ask.ask(asked, docs, chunks, top_k=21)
    for _ in range(2):
        ask.refresh_artifacts(docs, chunks, artifacts)
    assert artifacts.read().count() == 6


def test_vectors_by_a_client(spark):
    from tabulora.operators import embed

    rows = spark.createDataFrame([(k, "x" * k) for k in range(25)], "chunk_id long, t string")
    got = {r.chunk_id: r.embedding for r in embed.remote(rows, "chunk_id", "t", lambda ts: [[float(len(t)), float(len(ts) <= 10)] for t in ts]).collect()}
    assert got == {k: [float(k), 1.0] for k in range(25)}
    with pytest.raises(Exception, match="gave 0 vectors"):
        embed.remote(rows, "chunk_id", "t", lambda ts: []).collect()
    out = embed.indexed(spark.sql(fixtures.PASSAGES).join(spark.sql(fixtures.REPORTS).select("doc_id", "title", "company", "ticker"), "doc_id"), dim=16)
    assert out.count() == 7 and out.where("size(embedding) = 16 and tokenized_text <> ''").count() == 7


def test_names_of_any_length(spark):
    long = "很长的公司名称" * 20
    docs = spark.createDataFrame([(1, f"{long}题_2026_年报", "s", long, None), (2, "短_2026", "s", "短", None)], "doc_id long, title string, source string, company string, ticker string")
    asked = spark.createDataFrame([(1, f"请问{long}题的收入"), (2, "短"), (3, ""), (4, "无关")], "query_id long, query string")
    got = {r.query_id: (r.company, list(r.title_terms)) for r in retrieve.query_metadata(asked, docs).collect()}
    assert got == {1: (long, [f"{long}题"]), 2: ("短", []), 3: (None, []), 4: (None, [])}
