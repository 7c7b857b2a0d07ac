"""Evaluation and audit: golden cases against elements, passages, hits, facts and answers, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _holds(text: str, needles: str) -> Column:
    return F.forall(F.coalesce(needles, F.array().cast("array<string>")), lambda n: F.contains(F.coalesce(text, F.lit("")), n))


def parse_cases(cases: DataFrame, elements: DataFrame) -> DataFrame:
    """cases (name, doc_id, expected_text_contains, min_element_counts) with counts, n_elements and passed."""
    n = elements.groupBy("doc_id", "element_type").count()
    n = n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "count")))).alias("counts"), F.sum("count").alias("n_elements"))
    parts = F.array_sort(F.collect_list(F.when(F.col("element_type") == "text", F.struct("element_seq", "content"))))
    text = elements.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p.content), "\n\n").alias("_text"))
    rows = cases.join(n, "doc_id", "left").join(text, "doc_id", "left")
    least = F.coalesce(F.map_entries("min_element_counts"), F.array().cast("array<struct<key:string,value:int>>"))
    enough = F.forall(least, lambda e: F.coalesce(F.try_element_at("counts", e.key), F.lit(0)) >= e.value)
    return rows.select("name", "doc_id", F.coalesce("n_elements", F.lit(0)).alias("n_elements"), (_holds("_text", "expected_text_contains") & F.coalesce(enough, F.lit(True))).alias("passed"))


def chunk_cases(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """cases (name, doc_id, min_chunks, max_chunk_length, required_keyword, and maybe min_chunk_counts: a map from kinds of
    passages to numbers) with sizes of passages and passed."""
    joined = cases.select("name", "doc_id", "required_keyword").join(chunks, "doc_id", "left")
    size = F.length("content")
    n = joined.groupBy("name").agg(F.count("chunk_index").alias("n_chunks"), F.max(size).alias("longest"), F.round(F.avg(size), 2).alias("mean_length"), F.max(F.coalesce(F.contains("content", "required_keyword"), F.col("required_keyword").isNull())).alias("found"))
    rows = cases.join(n, "name")
    ok = (F.col("n_chunks") >= F.coalesce("min_chunks", F.lit(0))) & (F.coalesce("longest", F.lit(0)) <= F.coalesce("max_chunk_length", F.lit(1 << 30))) & F.coalesce("found", F.lit(False))
    if "min_chunk_counts" in cases.columns:
        # a row for each kind that a case asks for
        wanted = cases.select("name", "doc_id", F.explode("min_chunk_counts").alias("chunk_type", "least"))
        have = chunks.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("have"))
        few = wanted.join(have, ["doc_id", "chunk_type"], "left").where(F.coalesce("have", F.lit(0)) < F.col("least")).select("name").distinct().withColumn("_few", F.lit(True))
        rows = rows.join(few, "name", "left")
        ok &= F.col("_few").isNull()
    return rows.select("name", "doc_id", "n_chunks", "longest", "mean_length", ok.alias("passed"))


def match_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, ranks): ascending ranks of the hits that meet every expectation of a case that is not null."""
    rows = cases.join(hits, "query_id", "left")
    same = lambda want, have: F.col(want).isNull() | F.coalesce(F.col(want) == F.col(have), F.lit(False))
    ok = same("expected_title", "title") & same("expected_section", "section_title") & same("expected_chunk_type", "chunk_type") & same("expected_page", "page_number") & _holds("content", "expected_keywords")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(ok & F.col("rank").isNotNull(), F.col("rank")))).alias("ranks"))


def hit_rates(ranks: DataFrame) -> DataFrame:
    """cases, hit_at_1, hit_at_3."""
    first = F.try_element_at("ranks", F.lit(1))
    rate = lambda k: F.round(F.avg(F.coalesce((first <= k).cast("int"), F.lit(0))), 4)
    return ranks.agg(F.count("*").alias("cases"), rate(1).alias("hit_at_1"), rate(3).alias("hit_at_3"))


def answer_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (query_id, expected_answer_contains, expected_citation_title, forbid_refusal) with passed."""
    rows = cases.join(answers.select("query_id", "answer", "citations"), "query_id", "left")
    cited = F.coalesce(F.exists("citations", lambda c: c.title == F.col("expected_citation_title")), F.lit(False))
    refused = F.contains(F.coalesce("answer", F.lit("")), F.lit("没有足够证据"))
    ok = _holds("answer", "expected_answer_contains") & (F.col("expected_citation_title").isNull() | cited) & ~(F.coalesce("forbid_refusal", F.lit(False)) & refused)
    return rows.select("query_id", ok.alias("passed"))


def pass_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"))


def fact_cases(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """expected (doc_id, metric, value, min_confidence, source_page, quality_flag, fact_origin, maybe case_id) with passed;
    nulls are not checked."""
    have = facts.select("doc_id", "metric", *[F.col(c).alias(f"_{c}") for c in ("value", "confidence", "source_page", "quality_flag", "fact_origin")])
    rows = expected.join(have, ["doc_id", "metric"], "left")
    same = lambda c: F.col(c).isNull() | F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    sure = F.col("min_confidence").isNull() | F.coalesce(F.col("_confidence") >= F.col("min_confidence"), F.lit(False))
    return rows.select("doc_id", *[c for c in ("case_id",) if c in expected.columns], "metric", (F.col("_value").isNotNull() & same("value") & sure & same("source_page") & same("quality_flag") & same("fact_origin")).alias("passed"))


def report_cases(cases: DataFrame, infos: DataFrame, analysed: DataFrame) -> DataFrame:
    """(doc_id, passed, and case_id if cases have one) of cases (doc_id, expected_report_period, expected_derived_metrics: the whole list, in order,
    expected_usable: a map from raw_metrics, derived_metrics and excluded_metrics to what each must hold); nulls are not
    checked. infos: (doc_id, report_period); analysed: facts.analysis."""
    rows = cases.join(infos.select("doc_id", "report_period"), "doc_id", "left").join(analysed.select("doc_id", "raw_metrics", "derived_metrics", "excluded_metrics"), "doc_id", "left")
    none = F.array().cast("array<string>")
    of = F.create_map(*[x for c in ("raw_metrics", "derived_metrics", "excluded_metrics") for x in (F.lit(c), F.coalesce(c, none))])
    held = F.forall(F.coalesce(F.map_entries("expected_usable"), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: F.size(F.array_except(e.value, F.coalesce(F.try_element_at(of, e.key), none))) == 0)
    period = F.col("expected_report_period").isNull() | F.coalesce(F.col("report_period") == F.col("expected_report_period"), F.lit(False))
    derived = F.col("expected_derived_metrics").isNull() | (F.coalesce("derived_metrics", none) == F.col("expected_derived_metrics"))
    return rows.select("doc_id", *[c for c in ("case_id",) if c in cases.columns], (period & derived & held).alias("passed"))


def gold_fields(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """gold (doc_id, metric, value, expected_numeric_value, expected_normalized_value_cny) with correct: by number
    (1e-9 for eps, 1e-6 for amounts), else by text."""
    have = facts.select("doc_id", "metric", F.col("value").alias("_v"), F.col("numeric_value").alias("_n"), F.col("normalized_value_cny").alias("_y"))
    rows = gold.join(have, ["doc_id", "metric"], "left")
    eps, text = F.col("metric") == "eps_basic", F.col("_v") == F.col("value")
    near = lambda a, b, e: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.abs(F.col(a) - F.col(b)) < e)
    ok = F.coalesce(F.when(eps, near("expected_numeric_value", "_n", 1e-9)).otherwise(near("expected_normalized_value_cny", "_y", 1e-6)), text, F.lit(False))
    return rows.select("doc_id", "metric", ok.alias("correct"))


def field_accuracy(fields: DataFrame) -> DataFrame:
    """(metric, n, n_correct, accuracy)."""
    return fields.groupBy("metric").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))


def exact_documents(fields: DataFrame) -> DataFrame:
    """(documents, exact): documents, and those of which every field is right."""
    return fields.groupBy("doc_id").agg(F.bool_and("correct").alias("e")).agg(F.count("*").alias("documents"), F.count_if("e").alias("exact"))


def confidence_floor(confidence) -> Column:
    """The highest step of .9, .8, .7, .6, .5 that the confidence reaches, else cut to two places; null if not above 0."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    out = F.when(c.isNull() | (c <= 0), F.lit(None).cast("double"))
    for step in (0.9, 0.8, 0.7, 0.6, 0.5):
        out = out.when(c >= step, F.lit(step))
    return out.otherwise(F.floor(c * 100) / 100)


def expected_facts(facts: DataFrame) -> DataFrame:
    """(doc_id, expected_metrics as JSON): today's facts as cases for later."""
    one = F.struct("metric", F.struct("value", confidence_floor("confidence").alias("min_confidence"), "source_page", "quality_flag", "fact_origin").alias("m"))
    return facts.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))).alias("expected_metrics"))


def counters(rows: DataFrame, most: int | None = None, **columns: str) -> DataFrame:
    """(counter, name, n) of array columns, the commonest first; `most` for each, of equals the first by name."""
    out = None
    for counter, column in columns.items():
        one = rows.select(F.explode(column).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit(counter).alias("counter"), "name", "n")
        out = one if out is None else out.unionByName(one)
    if most:
        order = Window.partitionBy("counter").orderBy(F.desc("n"), "name")
        out = out.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return out


def audit(analyses: DataFrame, infos: DataFrame) -> DataFrame:
    """One row of totals over the documents' analyses and basic information."""
    rows = analyses.join(infos.select("doc_id", "industry"), "doc_id", "left")
    some = lambda c: F.count_if(F.size(c) > 0)
    named = F.coalesce("industry", F.lit("")) != ""
    return rows.agg(
        F.count("*").alias("total_documents"), F.count_if(named).alias("with_industry"), F.count_if(~named).alias("without_industry"), some("missing_metrics").alias("documents_with_missing_metrics"),
        some("low_confidence_metrics").alias("documents_with_low_confidence_metrics"), some("derived_metrics").alias("documents_with_derived_metrics"),
        F.sum(F.size("raw_metrics")).alias("usable_raw"), F.sum(F.size("derived_metrics")).alias("usable_derived"), F.sum(F.size("excluded_metrics")).alias("excluded"),
    )


def audit_csv(analyses: DataFrame) -> DataFrame:
    """Audit rows with lists joined by bars, ready for CSV."""
    lists = [f.name for f in analyses.schema if f.dataType.typeName() == "array" and f.name != "signals"]
    return analyses.select("doc_id", "available_metric_count", *[F.concat_ws(" | ", c).alias(c) for c in lists])


def open_reviews(reviews: DataFrame, log: DataFrame, status: str = "open", most: int | None = None) -> DataFrame:
    """Reviews of a status with their logged query, the newest first."""
    rows = reviews.where(F.col("status") == status).join(log.select(F.col("id").alias("query_log_id"), "query", F.col("answer").alias("logged")), "query_log_id")
    rows = rows.orderBy(F.col("id").desc())
    return rows.limit(most) if most else rows


def replayed(reviews: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, label, passed): reviews (id, label, expected_answer_contains, expected_citation_title, logged) against new
    answers (id, answer, citation_titles); a review without checks passes if the answer has changed."""
    rows = reviews.join(answers, "id")
    refused = F.contains(F.col("answer"), F.lit("没有足够证据"))
    needles = F.coalesce("expected_answer_contains", F.array().cast("array<string>"))
    cited = F.array_contains("citation_titles", F.col("expected_citation_title"))
    checks = F.concat(
        F.transform(needles, lambda n: F.contains(F.col("answer"), n)),
        F.when(F.coalesce("expected_citation_title", F.lit("")) != "", F.array(F.coalesce(cited, F.lit(False)))).otherwise(F.array().cast("array<boolean>")),
        F.when(F.col("label") == "should_refuse", F.array(refused)).when(F.col("label") == "bad_refusal", F.array(~refused)).otherwise(F.array().cast("array<boolean>")),
    )
    passed = F.when(F.size(checks) > 0, F.forall(checks, lambda c: c)).otherwise(~F.col("answer").eqNullSafe(F.col("logged")))
    return rows.select("id", "label", passed.alias("passed"))
