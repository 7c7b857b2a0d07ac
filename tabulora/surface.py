"""What SQL sees: table functions and views for splitting, retrieval and facts.

`register(spark)` adds table functions; `views(...)` adds views over stored documents and passages. Then, for instance,
SELECT c.doc_id, p.* FROM cleaned_documents c, LATERAL split_passages(c.text, c.section) p.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tabulora.operators import chunk, clean, facts, retrieve
from tabulora.plans import rules


@udtf(returnType="chunk_index int, content string")
class SplitPassages:
    """The passages of a text that stands in one section."""

    def eval(self, text: str, section: str) -> Iterator[tuple[int, str]]:
        most = chunk.KEY_TEXT if any(w in (section or "") for w in rules.KEY_SECTIONS) else chunk.TEXT
        run = chunk._Run()
        paragraph = " ".join((text or "").split())
        for part, _, _, content in [*run.add(paragraph, section, None, most), *run.end()]:
            yield part, content.strip()


@udtf(returnType="n int, unit string")
class TextUnits:
    """The units of at most so many characters that a paragraph is packed from."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk.units_of(" ".join((text or "").split()), most), start=1)


def register(spark: SparkSession) -> None:
    """Adds split_passages(text, section) and text_units(text, most)."""
    spark.udtf.register("split_passages", SplitPassages)
    spark.udtf.register("text_units", TextUnits)


def views(documents: DataFrame, chunks: DataFrame, questions: DataFrame | None = None, top_k: int = 5) -> None:
    """Adds views over documents (doc_id, title, source, company, ticker, industry, published_at, raw_text) and passages:
    cleaned_documents, passages, facts, analysis, and with questions (query_id, query) retrieved."""
    none = F.lit(None).cast("string")
    documents.select("doc_id", clean.clean_text(F.coalesce("raw_text", F.lit(""))).alias("text"), none.alias("section")).createOrReplaceTempView("cleaned_documents")
    passages = chunks.join(documents.select("doc_id", "title", "company", "ticker", "source"), "doc_id")
    passages.createOrReplaceTempView("passages")
    found = facts.extract(documents, chunks)
    found.createOrReplaceTempView("facts")
    facts.analysis(found, documents).createOrReplaceTempView("analysis")
    if questions is not None:
        retrieve.retrieve(questions, passages, documents, top_k=top_k).createOrReplaceTempView("retrieved")
