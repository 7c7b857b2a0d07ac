"""Questions over stored tables: retrieval, answers, the query log; facts and artifacts of stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.operators import answer, facts, retrieve, store
from tabulora.sources.tables import Table

MOST = 20


def passages_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages beside their document's fields."""
    fields = ["title", "company", "ticker", "source", "doc_type", "published_at"]
    return chunks.join(documents.select("doc_id", *fields), "doc_id")


def ask(questions: DataFrame, documents: DataFrame, chunks: DataFrame, top_k: int = 5, log: Table | None = None, tag: str = "interactive", **vectors) -> DataFrame:
    """Answers (query_id, query, answer, citations, …) to questions (query_id, query); empty ones are left out.

    With a log, a row for each question is added. vectors: `vectors` and `query_vectors` for the second leg.
    """
    if not 1 <= top_k <= MOST:
        raise ValueError(f"top_k is {top_k}, not 1 to {MOST}")
    asked = questions.where("query is not null and query <> ''")
    passages = passages_of(documents, chunks)
    hits = retrieve.retrieve(asked, passages, documents, top_k=top_k, **vectors).join(passages, "chunk_id")
    answers = answer.answer(asked, hits, top_k)
    if log is not None:
        rows = answer.log_rows(answers, hits, top_k, tag)
        log.append(rows.select(F.abs(F.xxhash64("query_id", "query", F.current_timestamp())).alias("id"), "query", "rewritten_query", "answer", "sources", F.current_timestamp().alias("created_at")))
    return answers


def refresh_artifacts(documents: DataFrame, chunks: DataFrame, artifacts: Table, layout: DataFrame | None = None) -> DataFrame:
    """Facts of all documents; both artifacts of each take the place of the stored ones of the same version."""
    found = facts.extract(documents, chunks, layout)
    new = facts.payloads(documents, found).select("doc_id", "artifact_type", F.lit("v1").alias("version"), F.lit("ready").alias("status"), "payload")
    artifacts.replace(store.upsert_by(artifacts.read(), new, ["doc_id", "artifact_type", "version"]))
    return found
