"""Files of evaluation cases (parse, chunk, retrieval, facts and answer cases as JSON) against stored documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.operators import answer, evaluate, facts, retrieve

LAYERS = ("chunk", "retrieval", "facts", "answer")


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _titled(spark: SparkSession, rows: list[dict], documents: DataFrame, schema: str, *fields: str) -> DataFrame:
    """Cases with the newest document of their title, null if there is none."""
    made = [(i, r.get("name") or str(i), r.get("document_title") or r.get("source"), *[r.get(f) for f in fields]) for i, r in enumerate(rows)]
    cases = spark.createDataFrame(made, f"case_id long, name string, _title string, {schema}")
    known = documents.groupBy(F.col("title").alias("_title")).agg(F.max("doc_id").alias("doc_id"))
    return cases.join(known, "_title", "left").drop("_title")


def retrieval_rates(spark: SparkSession, cases: list[dict], documents: DataFrame, passages: DataFrame, top_k: int = 3) -> DataFrame:
    """cases, hit_at_1, hit_at_3."""
    fields = ["query", "expected_title", "expected_section", "expected_chunk_type", "expected_page", "expected_keywords"]
    rows = [(i, *[c.get(f) for f in fields]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "query_id long, query string, expected_title string, expected_section string, expected_chunk_type string, expected_page int, expected_keywords array<string>")
    hits = retrieve.retrieve(df.select("query_id", "query"), passages, documents, top_k=top_k).join(passages, "chunk_id")
    return evaluate.hit_rates(evaluate.match_ranks(df, hits.select("query_id", "rank", "title", "section_title", "chunk_type", "page_number", "content")))


def answer_passed(spark: SparkSession, cases: list[dict], documents: DataFrame, passages: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, passed) of answers by the summary of evidence."""
    rows = [(i, c.get("query"), c.get("expected_answer_contains"), c.get("expected_citation_title"), c.get("forbid_refusal")) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "query_id long, query string, expected_answer_contains array<string>, expected_citation_title string, forbid_refusal boolean")
    hits = cut(retrieve.retrieve(df.select("query_id", "query"), passages, documents, top_k=top_k).join(passages, "chunk_id"))
    return evaluate.answer_cases(df, answer.answer(df.select("query_id", "query"), hits, top_k))


def facts_passed(spark: SparkSession, cases: list[dict], documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, passed): whole cases, each metric and what is asked of the document."""
    base = cut(_titled(spark, cases, documents, "expected_report_period string, expected_derived_metrics array<string>, expected_usable map<string,array<string>>", "expected_report_period", "expected_derived_metrics", "expected_usable_for_calc_contains"))
    found = cut(facts.extract(documents, chunks))
    wide = evaluate.report_cases(base, facts.basic_info(documents), facts.analysis(found, documents))
    metrics = [(i, k, m.get("value"), m.get("min_confidence"), m.get("source_page"), m.get("quality_flag"), m.get("fact_origin")) for i, c in enumerate(cases) for k, m in c.get("expected_metrics", {}).items()]
    each = spark.createDataFrame(metrics, "case_id long, metric string, value string, min_confidence double, source_page int, quality_flag string, fact_origin string").join(base.select("case_id", "doc_id"), "case_id")
    failed = evaluate.fact_cases(each, found).where("not passed").select("case_id").distinct().withColumn("_failed", F.lit(True))
    ok = F.col("doc_id").isNotNull() & F.coalesce("passed", F.lit(False)) & F.col("_failed").isNull()
    return base.join(wide.drop("doc_id"), "case_id", "left").join(failed, "case_id", "left").select("name", ok.alias("passed"))


def chunks_passed(spark: SparkSession, cases: list[dict], documents: DataFrame, chunks: DataFrame) -> DataFrame:
    fields = ["min_chunks", "max_chunk_length", "required_keyword", "min_chunk_counts"]
    df = _titled(spark, cases, documents, "min_chunks int, max_chunk_length int, required_keyword string, min_chunk_counts map<string,int>", *fields)
    return evaluate.chunk_cases(df, chunks).select("name", "passed")


def run(spark: SparkSession, cases: dict, documents: DataFrame, chunks: DataFrame, layer: str = "all") -> DataFrame:
    """(layer, cases, passed, rate): retrieval counts hits among the first three."""
    fields = ["title", "company", "ticker", "source", "doc_type", "published_at"]
    passages = chunks.join(documents.select("doc_id", *fields), "doc_id")
    out = spark.createDataFrame([], "layer string, cases long, passed long, rate double")
    for name in LAYERS if layer == "all" else (layer,):
        rows = cases.get(f"{name}_cases") or []
        if not rows:
            continue
        if name == "retrieval":
            rates = retrieval_rates(spark, rows, documents, passages)
            one = rates.select("cases", F.round(F.col("hit_at_3") * F.col("cases")).cast("long").alias("passed"), F.col("hit_at_3").alias("rate"))
        elif name == "answer":
            one = evaluate.pass_rate(answer_passed(spark, rows, documents, passages)).toDF("cases", "passed", "rate")
        else:
            one = evaluate.pass_rate((facts_passed if name == "facts" else chunks_passed)(spark, rows, documents, chunks)).toDF("cases", "passed", "rate")
        out = out.unionByName(one.select(F.lit(name).alias("layer"), F.col("cases").cast("long"), F.col("passed").cast("long"), F.col("rate").cast("double")))
    return out
