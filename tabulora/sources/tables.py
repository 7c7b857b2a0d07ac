"""Versioned Parquet tables, and JSON and CSV sinks.

A write makes the next version from whatever plan, also one that reads the table itself, and readers take the last version
that was finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.sources.parts import Parts

#: Columns of the stored relations.
DOCUMENTS = "doc_id bigint, title string, source string, doc_type string, company string, ticker string, industry string, published_at timestamp_ntz, version string, raw_text string"
CHUNKS = "chunk_id bigint, doc_id bigint, chunk_index int, chunk_type string, section_title string, table_title string, figure_title string, page_number int, content string, token_count int"
ARTIFACTS = "doc_id bigint, artifact_type string, version string, status string, payload string"
QUERY_LOGS = "id bigint, query string, rewritten_query string, answer string, sources string, latency_ms int, created_at timestamp"
REVIEWS = "id bigint, query_log_id bigint, label string, status string, expected_answer_contains array<string>, expected_citation_title string, note string, created_at timestamp"


class Table:
    """One table: appended rows go to new files, a replacement is a new list of files (see sources.parts)."""

    NAME = "rows"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, Parts(spark, path)

    def versions(self) -> list[int]:
        return self.parts.versions()

    def version(self) -> int:
        return self.parts.live()[0]

    def read(self) -> DataFrame:
        """The rows as of the last finished write; an empty table if there is none."""
        return self.parts.read(self.NAME, self.schema).drop("part")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], self.schema).unionByName(rows, allowMissingColumns=True).select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema])

    def replace(self, rows: DataFrame, base: int | None = None) -> None:
        """All rows anew. base: the version that the rows follow from, if no other write may come between."""
        self.parts.add({self.NAME: self._shaped(rows)}, replace=True, base=base)

    def append(self, rows: DataFrame) -> None:
        """More rows; what is there is neither read nor written again."""
        self.parts.add({self.NAME: self._shaped(rows)})

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        return self.parts.vacuum(keep, hours)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by bars."""
    flat = [F.concat_ws(" | ", f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)
