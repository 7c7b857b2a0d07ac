"""Full-text search with AND, ranked by how near a query's terms stand to each other.

Weights follow the public ts_rank formula for words without labels: of several terms each pair of places adds
w = 0.1 * sqrt(nearness(distance)), combined as 1 - prod(1 - w); of a single term its places add 0.1 / k^2. Places are
counted up to PLACE, and of a term the first PLACES count.

Texts are found by a query's rarest term and checked for the others by equality, so common words are never multiplied by
the queries that hold them; places are looked up only in texts that hold all terms.

Defined results: a query without terms finds nothing; a null text holds none; ties go to the smaller page, then index,
then chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulora.functions.tokens import lexical_tokens
from tabulora.operators import postings

#: Fixed values of the public formula: weight of a word, farthest place, places of a term, reach, limit of sum(1 / k^2).
WEIGHT, PLACE, PLACES, REACH, LIMIT = 0.1, 16383, 256, 100, 1.64493406685


def matches(queries: DataFrame, index: postings.Index) -> DataFrame:
    """(query_id, chunk_id) of the texts that hold every token of the query."""
    terms = postings.query_terms(queries)
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    counted = terms.join(index.terms.select("term", "df"), "term").where("df > 0")
    # a query with a term that no text holds finds nothing
    whole = counted.groupBy("query_id").agg(F.count("*").alias("need"), F.min(F.struct("df", "term")).alias("r")).join(need, ["query_id", "need"])
    found = whole.select("query_id", "need", F.col("r.term").alias("term")).join(index.postings.select("term", "chunk_id"), "term").select("query_id", "chunk_id", "need")
    held = found.join(terms, "query_id").join(index.postings.select("chunk_id", "term"), ["chunk_id", "term"])
    return held.groupBy("query_id", "chunk_id", "need").agg(F.count("*").alias("have")).where("have = need").select("query_id", "chunk_id")


def _nearness(distance: Column) -> Column:
    return F.when(distance > REACH, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def closeness(places: Column) -> Column:
    """The rank of a text from the places of each term (an array of arrays)."""
    one = F.element_at(places, 1)
    steps = F.sequence(F.lit(1), F.greatest(F.size(one), F.lit(1)))
    # equal weights: the largest is the first, so what is left of the public formula is the sum
    single = F.aggregate(steps, F.lit(0.0), lambda s, k: s + WEIGHT / (k * k).cast("double")) / LIMIT

    def pair(a: Column, b: Column) -> Column:
        each = lambda s, x: F.aggregate(b, s, lambda s2, y: s2 + F.log1p(-WEIGHT * F.sqrt(_nearness(F.abs(x - y).cast("double")))))
        return F.aggregate(a, F.lit(0.0), each)

    at = F.sequence(F.lit(2), F.greatest(F.size(places), F.lit(2)))
    before = lambda k: F.aggregate(F.slice(places, F.lit(1), k - 1), F.lit(0.0), lambda s, a: s + pair(a, F.element_at(places, k)))
    logs = F.aggregate(at, F.lit(0.0), lambda s, k: s + before(k))
    return F.when(F.size(places) == 1, single).otherwise(-F.expm1(logs))


def full_text(queries: DataFrame, texts: DataFrame, top_k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best top_k texts (all, if None) that hold all terms of a query, by closeness;
    the point for a text that holds the query as a whole is added afterwards and does not change the order.

    texts: (chunk_id, doc_id, text), and page_number and chunk_index where ties shall follow them.
    """
    index, _ = postings.in_memory(texts.select("chunk_id", "doc_id", "text"), postings.query_terms(queries))
    ties = [c for c in ("page_number", "chunk_index") if c in texts.columns]
    terms = postings.query_terms(queries).groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    rows = matches(queries, index).join(terms, "query_id").join(queries.select("query_id", "query"), "query_id").join(texts.select("chunk_id", "text", *ties), "chunk_id")
    rows = rows.withColumn("_t", lexical_tokens("text"))
    at = F.sequence(F.lit(1), F.greatest(F.size("_t"), F.lit(1)))
    place = lambda term: F.transform(F.slice(F.filter(at, lambda i: F.try_element_at("_t", i) == term), 1, PLACES), lambda i: F.least(i, F.lit(PLACE)))
    rows = rows.select("query_id", "chunk_id", *ties, F.contains("text", "query").alias("whole"), F.transform("terms", place).alias("places"))
    rows = rows.select("query_id", "chunk_id", *ties, "whole", closeness(F.col("places")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *ties, "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if top_k is None else rows.where(F.col("rank") <= top_k)
    return rows.select("query_id", "chunk_id", (F.col("score") + F.when(F.col("whole"), 1.0).otherwise(0.0)).alias("score"), "rank")
