"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go; of each group of near duplicates (five words, 0.8) the one with the least id stays; passages that
repeat from documents with smaller ids are cut out of the texts; documents that hold a benchmark item go; the rest is
encoded. All stages but the last return the columns of documents, further ones included, whatever their names.

Defined results, for all stages: null and empty texts stay as they are (no score of toxicity but the model's of an empty
text, linked with nothing, nothing to cut, no item, no tokens); an empty table gives an empty table; very long texts are
taken whole; each row is judged by its own text, also where rows share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.llm import bpe, decontaminate, jaccard, substrings, toxicity
from tabulora.llm.common import Work, free_name


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score below 0.5. The model is fitted on a bounded sample of the labelled documents; without
    labels it rejects nothing. Equal texts have equal scores, so copies stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    name = free_name(docs, "_toxicity")
    return toxicity.with_score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the least id; of rows that share it, the one with the least hash of its shingles, then
    the least in the order of the columns. A row without an id stays only where its group has none. Rows without words
    all stay."""
    return jaccard.one_of_each(docs, size=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows. Rows without an id are left whole; repeats within an id
    stay."""
    out = substrings.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item. Rows with equal id and text go together; a null id is as good as any."""
    name = free_name(docs, "_key")
    held = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("key").alias(name)).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return docs.withColumn(name, key).join(held, name, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Trained and tokenising stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
