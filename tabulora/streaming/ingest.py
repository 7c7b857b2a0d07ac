"""New text files become documents and passages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulora.plans.ingest import ingest
from tabulora.sources.tables import Table


def watch(spark: SparkSession, folder: str, documents: Table, chunks: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingests the folder's new text files; with `once` what is there now, then it ends.

    A batch that is written again after a failure replaces its own documents by their source, so nothing is doubled.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = rows.select(F.col("path").alias("source"), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("title"), F.lit("txt").alias("doc_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        ingest(new, documents, chunks)

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{txt,md}").load(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
