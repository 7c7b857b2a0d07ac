"""Vectors for passages: by feature hashing, or by a client that runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.functions.tokens import lexical_tokens, passage_text
from tabulora.functions.vectors import hashed_counts

DIM, BATCH = 1536, 10


def hashed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding): dense unit vectors; texts without tokens have none. Entries meet by key, at most dim of them."""
    of = hashed_counts(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    return of.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def remote(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(key, embedding) by a client that turns at most `batch` texts into as many vectors; another number is an error."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for k in range(0, len(pdf), batch):
                texts = pdf["t"].iloc[k : k + batch].tolist()
                vectors = client(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
                out += vectors
            yield pd.DataFrame({"k": pdf["k"], "embedding": out})

    return df.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInPandas(run, "k long, embedding array<double>").withColumnRenamed("k", key)


def indexed(passages: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, dim: int = DIM) -> DataFrame:
    """passages with tokenized_text and embedding, both from the same text; embed maps (chunk_id, text) to vectors."""
    rows = passages.withColumn("_text", passage_text())
    source = rows.select("chunk_id", F.col("_text").alias("text"))
    vectors = embed(source) if embed else hashed(source, "chunk_id", "text", dim)
    return rows.withColumn("tokenized_text", F.array_join(lexical_tokens("_text"), " ")).drop("_text").join(vectors, "chunk_id", "left")
