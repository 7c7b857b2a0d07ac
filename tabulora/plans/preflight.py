"""What is there before a run: rows of stored tables, settings with secrets masked, and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.operators.store import counts, masked

#: Settings that are secrets, and pairs of settings without which something falls back.
SECRETS = ("embedding_api_key", "llm_api_key")
NEEDS = {
    "embedding": (("embedding_base_url", "embedding_model"), "Embedding endpoint is not configured; vectors are hashed."),
    "llm": (("llm_base_url", "llm_model"), "LLM endpoint is not configured; answers are summaries of evidence."),
}


def report(spark: SparkSession, settings: dict[str, str | None], **tables: DataFrame) -> DataFrame:
    """(section, name, value): runtime, database and warning rows."""
    shown = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(settings.items())], "name string, value string")
    rows = shown.select(F.lit("runtime").alias("section"), "name", F.when(F.col("name").isin(*SECRETS), masked(F.coalesce("value", F.lit("")))).otherwise(F.col("value")).alias("value"))
    state = [(f"{k}_configured", str(all(settings.get(n) for n in names)).lower(), note) for k, (names, note) in NEEDS.items()]
    rows = rows.unionByName(spark.createDataFrame([("runtime", n, v) for n, v, _ in state], "section string, name string, value string"))
    rows = rows.unionByName(spark.createDataFrame([("warning", n, note) for n, v, note in state if v == "false"], "section string, name string, value string"))
    if tables:
        rows = rows.unionByName(counts(**tables).select(F.lit("database").alias("section"), "name", F.col("n").cast("string").alias("value")))
    return rows
