"""Stored relations: identity and replacement of documents, newest of a key, lists, logs and reviews.

Plain Parquet has no MERGE: a replacement is an anti-join and a union, written to a new version (see sources.tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulora.functions.metadata import identity


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old that new replaces: same source, same title, or same ticker and report identity.

    The OR is three anti-joins by equality, so none needs to compare all with all.
    """
    return old.join(kept(old, new).select("doc_id"), "doc_id", "left_anti")


def kept(old: DataFrame, new: DataFrame) -> DataFrame:
    named = new.where("ticker is not null").select(F.col("ticker").alias("_t"), identity("title", "source").alias("_i")).where("_i is not null").distinct()
    out = old.join(new.select(F.col("source").alias("_s")).distinct(), F.col("source") == F.col("_s"), "left_anti")
    out = out.join(new.select(F.col("title").alias("_n")).distinct(), F.col("title") == F.col("_n"), "left_anti")
    return out.withColumn("_id", identity("title", "source")).join(named, (F.col("ticker") == F.col("_t")) & (F.col("_id") == F.col("_i")), "left_anti").drop("_id")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without what new replaces, and new."""
    return kept(old, new).unionByName(new)


def upsert_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new take the place of those of old with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def newest(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, nulls last, of equals the one with the largest tie."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolve(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, doc_id): a target of six digits is the newest document of that ticker, another one an id."""
    t = targets.select("target").distinct().withColumn("by_ticker", F.col("target").rlike("^[0-9]{6}$"))
    last = newest(documents.where("ticker is not null"), "ticker", "published_at", "doc_id").select(F.col("ticker").alias("target"), "doc_id")
    by_id = documents.select(F.col("doc_id").cast("string").alias("target"), "doc_id")
    return t.where("by_ticker").join(last, "target").select("target", "doc_id").unionByName(t.where("not by_ticker").join(by_id, "target").select("target", "doc_id"))


def document_list(documents: DataFrame, chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """documents with chunk_count and their distinct artifact types, the largest id first."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    kinds = artifacts.groupBy("doc_id").agg(F.array_sort(F.collect_set("artifact_type")).alias("artifact_types"))
    out = documents.join(n, "doc_id", "left").join(kinds, "doc_id", "left")
    out = out.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("artifact_types", F.coalesce("artifact_types", F.array().cast("array<string>")))
    return out.orderBy(F.desc("doc_id"))


def copied(source: DataFrame, target: DataFrame) -> DataFrame:
    """Documents of source that are not in target by their source."""
    return source.join(target.select("source").distinct(), "source", "left_anti")


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last n rows of a log (id, created_at, …)."""
    return log.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(n)


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table, one scan each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def masked(secret):
    """A secret's first and last four characters with stars between, or only stars if it is short."""
    s = F.col(secret) if isinstance(secret, str) else secret
    n = F.length(s)
    return F.when(F.coalesce(s, F.lit("")) == "", "").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(s, -4, 4)))
