"""The command line, files of cases, the report before a run and the exports of gold seeds."""

import json

from pyspark.sql import functions as F

from tabulora.__main__ import main
from tabulora.operators import goldseed
from tabulora.plans import fixtures, preflight
from tabulora.sources import tables


def stored(spark, path):
    docs = spark.sql(fixtures.REPORTS).withColumns({"doc_type": F.lit("pdf"), "version": F.lit("v1"), "published_at": F.lit(None).cast("timestamp_ntz"), "doc_id": F.col("doc_id").cast("long")})
    tables.Table(spark, f"file://{path}/documents", tables.DOCUMENTS).append(docs)
    tables.Table(spark, f"file://{path}/chunks", tables.CHUNKS).append(spark.sql(fixtures.PASSAGES).withColumn("token_count", F.length("content")))


def test_eval_and_preflight(spark, tmp_path, capsys):
    stored(spark, tmp_path)
    title = "600519_贵州茅台_2026_Q1报"
    cases = {
        "chunk_cases": [{"name": "a", "document_title": title, "min_chunks": 4, "min_chunk_counts": {"table": 3, "text": 1}}, {"name": "b", "document_title": title, "min_chunk_counts": {"image": 1}}],
        "retrieval_cases": [{"query": "招商银行 总资产", "expected_title": "600036_招商银行_2026_Q1报"}, {"query": "招商银行 总资产", "expected_page": 77}],
        "facts_cases": [{"document_title": title, "expected_report_period": "2026Q1", "expected_metrics": {"total_assets": {"value": "91,000.00", "min_confidence": 0.5}}}, {"document_title": title, "expected_report_period": "2025Q1"}, {"document_title": "unknown"}],
        "answer_cases": [{"query": "招商银行 总资产", "expected_answer_contains": ["1,000"], "forbid_refusal": True}],
    }
    (tmp_path / "cases.json").write_text(json.dumps(cases), encoding="utf-8")
    assert main(["eval", f"file://{tmp_path}/cases.json", f"file://{tmp_path}"]) == 1
    said = capsys.readouterr().out
    assert "chunk: 1 of 2" in said and "retrieval: 1 of 2" in said and "answer: 1 of 1" in said and "facts: 1 of 3" in said
    assert main(["preflight", f"file://{tmp_path}"]) == 0 and main(["run", "nothing", ""]) == 2
    assert "bm25_topk" in (main(["queries"]), capsys.readouterr().out)[1]


def test_preflight_masks_secrets(spark):
    rows = {(r.section, r.name): r.value for r in preflight.report(spark, {"llm_base_url": "u", "llm_model": "m", "llm_api_key": "abcdefghij", "embedding_model": None}, t=spark.range(3)).collect()}
    assert rows["runtime", "llm_api_key"] == "abcd**ghij" and rows["runtime", "llm_configured"] == "true" and rows["database", "t"] == "3"
    assert ("warning", "embedding_configured") in rows and ("warning", "llm_configured") not in rows


def test_gold_seed_exports(spark):
    docs = spark.sql(fixtures.REPORTS)
    best = goldseed.candidates(docs.select("doc_id", F.lit(1).alias("page"), F.col("raw_text").alias("text")))
    rows = goldseed.long_rows(best, docs)
    assert rows.columns == ["document_title", "metric", "value", "unit", "normalized_value_cny", "page", "term", "score", "line"] and rows.where("metric = 'revenue'").count() >= 1
    cases = {r.document_title: r for r in goldseed.fact_cases(best, docs).collect()}
    assert len(cases) == 3 and cases["空白报告"].expected_metrics is None and cases["600519_贵州茅台_2026_Q1报"].expected_report_period == "2026Q1"
    assert cases["600519_贵州茅台_2026_Q1报"].expected_metrics["revenue"].value == "5,000.00"
