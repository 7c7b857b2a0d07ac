"""Ingestion: documents to cleaned elements, metadata, passages and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.functions import metadata
from tabulora.operators.chunk import split_elements
from tabulora.operators.clean import clean_elements
from tabulora.operators.store import kept
from tabulora.sources.tables import Table


def described(documents: DataFrame) -> DataFrame:
    """documents (doc_id, title, source, doc_type, text) with company, ticker, industry, published_at, version, raw_text."""
    code = F.coalesce(metadata.ticker("title"), metadata.ticker("text"))
    rows = documents.withColumn("company", metadata.company("title")).withColumn("ticker", code)
    rows = rows.withColumn("industry", metadata.industry("title", "text", "ticker")).withColumn("published_at", metadata.published("text"))
    return rows.withColumn("version", F.lit("v1")).withColumnRenamed("text", "raw_text")


def chunked(documents: DataFrame) -> DataFrame:
    """Passages of text documents (doc_id, text)."""
    none = F.lit(None).cast("string")
    elements = documents.select("doc_id", F.lit(0).alias("element_seq"), F.lit("text").alias("element_type"), F.col("text").alias("content"), F.lit(1).alias("page_number"), none.alias("section_title"), none.alias("table_title"), none.alias("figure_title"))
    return split_elements(clean_elements(elements))


def ingest(new: DataFrame, documents: Table, chunks: Table) -> None:
    """Adds documents (source, title, doc_type, text), in place of those that they replace, with their passages."""
    rows = described(new.withColumn("doc_id", F.abs(F.xxhash64("source"))))
    parts = chunked(rows.select("doc_id", F.col("raw_text").alias("text"))).withColumn("chunk_id", F.abs(F.xxhash64("doc_id", "chunk_index")))
    base = documents.version()
    old = documents.read()
    left = kept(old, rows)
    if old.join(left.select("doc_id"), "doc_id", "left_anti").isEmpty():
        # nothing to take out: new files beside the old ones
        documents.append(rows)
        chunks.append(parts)
        return
    chunks.replace(chunks.read().join(left.select("doc_id"), "doc_id", "left_semi").unionByName(parts, allowMissingColumns=True))
    documents.replace(left.unionByName(rows, allowMissingColumns=True), base=base)
