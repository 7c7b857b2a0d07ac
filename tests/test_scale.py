"""Work that must not grow faster than the input: equal questions, shared filters, shared rows, expressions that are not copied."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tabulora.functions import metadata
from tabulora.functions.vectors import hashed_counts
from tabulora.operators import clean, facts, layout, retrieve
from tabulora.plans import derived, fixtures, queries, report_queries
from tabulora.plans.ingest import described
from tests.oracle import SF


def asked_twice(spark):
    q = spark.sql(fixtures.QUESTIONS).withColumn("query_id", F.col("query_id").cast("long"))
    return q.unionByName(q.withColumn("query_id", F.col("query_id") + 100)).unionByName(q.selectExpr("query_id + 200 as query_id", "concat(' ', query) as query"))


def library(spark):
    docs = spark.sql(fixtures.REPORTS)
    return spark.sql(fixtures.PASSAGES).join(docs.select("doc_id", "title", "company", "ticker", "source"), "doc_id"), docs


def test_equal_questions_are_searched_once(spark, monkeypatch):
    plain, seen = retrieve.bm25, []
    monkeypatch.setattr(retrieve, "bm25", lambda q, *rest: seen.append(q.count()) or plain(q, *rest))
    got: dict = {}
    for r in retrieve.retrieve(asked_twice(spark), *library(spark), top_k=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score, tuple(r.reasons))
    assert seen == [6]
    assert all(got[k] == got[k + 100] == got[k + 200] for k in (1, 2, 3, 4, 6)) and got[2][1][0] == 21


def test_questions_without_words_keep_out(spark):
    asked = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "招商银行 总资产"), (5, "招商银行  总资产")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.retrieve(asked, *library(spark), top_k=1).collect()}
    assert got == {(4, 1): 21, (5, 1): 21}


def test_filters_that_queries_share_are_met_once(spark):
    _, docs = library(spark)
    meta = retrieve.query_metadata(asked_twice(spark), docs)
    assert {r.query_id for r in meta.where(retrieve.filter_key().isNull()).collect()} == {k + d for k in (4, 5, 6) for d in (0, 100, 200)}
    assert retrieve.key_scopes(meta, docs).count() == 3
    assert {(r.query_id % 100, r.doc_id) for r in retrieve.scopes(meta, docs).collect()} == {(1, 1), (2, 2), (3, 1)} and retrieve.scopes(meta, docs).count() == 9


def test_title_expressions_are_not_copied(spark):
    df = spark.createDataFrame([("资产负债表 明细 | 1", "单位：元", "一、重要事项", 2, 1, 200.0)], "content string, caption string, section string, page int, i int, y double")
    title = layout.table_title("section", "caption", layout.inferred_title("content"), "section", "page", "i", F.col("y"))
    plan = df.select(title.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20
    marked = layout.marked(df.withColumn("text", F.col("section")))
    assert layout.marked(marked) is marked and marked.first().mark == "一、重要事项"


def test_items_are_joined_once_for_all_elements(spark):
    out = report_queries.report_elements(spark, SF)
    assert "lineitem" not in "".join(out.inputFiles()) and out.count() > 0


def test_places_of_tokens_are_counted_before_an_exchange(spark):
    df = spark.createDataFrame([(1, "a b a 资"), (1, "b"), (2, None)], "doc_id long, text string")
    for dim in (64, 1536, 1):
        counts = Counter(int(hashlib.md5(t.encode()).hexdigest(), 16) % dim for t in ("a", "b", "a", "资", "b"))
        norm = math.sqrt(sum(n * n for n in counts.values()))
        out = hashed_counts(df, "doc_id", "text", dim)
        assert {(r.doc_id, r.idx): round(r.value, 9) for r in out.collect()} == {(1, i): round(n / norm, 9) for i, n in counts.items()}
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_industries_are_sought_in_one_form(spark):
    df = spark.createDataFrame([("某 银行", "所属行业：酿 酒 主营业务"), ("某", "芯 片 硅 片")], "title string, text string")
    rows = df.select(metadata.industry("title", "text", F.lit(None).cast("string")).alias("i"))
    assert [r.i for r in rows.collect()] == ["白酒", "半导体"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 12


def test_titles_of_lines_take_one_form(spark):
    df = spark.createDataFrame([(["单位：元", "收入构成 明细"],)], "ls array<string>").select(F.filter("ls", clean.is_weak_title).alias("w"), F.transform("ls", clean.title_candidate).alias("t"))
    assert df.first().w == ["单位：元"] and df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 5


def test_narrow_tables_are_dealt_out(spark):
    for name in ("REPORTS", "PASSAGES", "FACTS", "TITLES"):
        assert derived.frame(spark, SF, name).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_sections_carry_tables_through_whole(spark):
    lines = spark.createDataFrame([(1, 1, 1, 10.0, "一、主要会计数据"), (None, 1, 2, 10.0, "二、重要事项")], "doc_id long, page int, seq int, y double, text string")
    tables = spark.createDataFrame([(1, 1, 1, 20.0), (1, 1, 1, 20.0), (1, 1, 2, 5.0), (None, 1, 1, 20.0)], "doc_id long, page int, table_idx int, y0 double")
    out = layout.sections_before(lines, tables)
    assert sorted((r.doc_id or 0, r.table_idx, r.section or "") for r in out.collect()) == [(0, 1, ""), (1, 1, "一、主要会计数据"), (1, 1, "一、主要会计数据"), (1, 2, "")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_pages_are_joined_once(spark):
    for name in ("section_asof", "page_layout"):
        assert "lineitem" not in "".join(queries.QUERIES[name](spark, SF).inputFiles())


def test_best_facts_are_found_once(spark):
    f = facts.extract(spark.sql(fixtures.REPORTS).withColumn("industry", F.lit(None).cast("string")).withColumn("published_at", F.lit(None).cast("timestamp")), spark.sql(fixtures.PASSAGES))
    assert f.count() > 0 and "Window" not in f._jdf.queryExecution().optimizedPlan().toString()


def test_whole_texts_are_described(spark):
    long = "正文。" * 8000
    texts = [long + "所属行业：房地产 主营业务 600519 2026-04-30", long + " 600518 芯片 硅片"]
    docs = spark.createDataFrame([(i, "某", "s", "pdf", t) for i, t in enumerate(texts)], "doc_id long, title string, source string, doc_type string, text string")
    got = [(r.ticker, r.industry, str(r.published_at)[:10]) for r in described(docs).orderBy("doc_id").collect()]
    assert got == [("600519", "白酒", "2026-04-30"), ("600518", "半导体", "None")]
    assert [r.i for r in docs.where("doc_id = 0").select(metadata.industry_from_label("text").alias("i")).collect()] == ["房地产"]


def test_lists_of_documents_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PIECE", 3)
    monkeypatch.setattr(retrieve, "SHARE", 4)
    docs = spark.range(-5, 40).selectExpr("id doc_id", "concat('600519_贵州茅台_', id) title", "'s' source", "if(id < 0, '000001', '600519') ticker", "'贵州茅台' company")
    meta = retrieve.query_metadata(spark.range(80).selectExpr("id query_id", "case when id = 79 then 'no filter' when id = 78 then '600000 x' when id < 70 then '贵州茅台' else '600519 x' end query"), docs)
    out = retrieve.listed(meta, docs)
    got = {r.query_id: r.docs for r in out.collect()}
    every, own = ",".join(map(str, range(-5, 40))), ",".join(map(str, range(40)))
    assert len(got) == out.count() == 80 and all(got[i] == every for i in range(70)) and all(got[i] == own for i in range(70, 78)) and got[78] is None and got[79] is None
    # the queries of one filter come from several tasks, and pages of long rows are closed row by row
    monkeypatch.setattr(retrieve, "SHARE", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert retrieve.listed(meta, docs).where("query_id < 70").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SortMergeJoin [filter_key" in out._jdf.queryExecution().sparkPlan().toString() and all(spark.conf.get(n) == "1" for n in retrieve.PAGE_ROWS)
