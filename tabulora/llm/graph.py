"""Connected components by alternating large and small stars, as joins and combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import Work, partitions

#: Edges that one task writes at least.
SHARE = 100_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


def components(work: Work, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node of its component.

    A node with very many edges is one row of the combined minima and a join key that Spark may split. The number of
    rounds grows with the logarithm of the nodes; each is written, so nothing is computed twice.
    """
    mark, k = None, 0
    now = work.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    n = now.count()
    while True:
        k += 1
        # the edges never become more than nodes and edges were
        tasks = min(partitions(work.spark), 2 * n // SHARE + 1)
        new = work.write(_small(_large(now)).distinct().coalesce(tasks), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        # the edges are settled when they no longer change; a sum of hashes stands for the set
        got = new.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            return new.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(new.select("b", "b").distinct())
        mark, now = tuple(got), new
