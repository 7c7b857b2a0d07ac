"""Keyword search over postings: a row for each term of each text, in memory or stored.

Texts are scored where they lie: the postings of the queries' terms are dealt out by text and packed, and each pair of a
pack and a block of queries is one product of matrices (terms by queries, texts by terms) in a task, which keeps the best
of each query. What is shuffled is a row for each posting, and a few rows for each query and task; hits are not listed.
Queries that hold the same indexed terms have the same scores but for the extra point and are scored once.

The extra point for texts that hold the query as a whole can only lift a text, so it is enough to add the texts that get it
to the best without it. They are found by the query's rarest inner tokens, which such a text must hold; a query without
inner tokens (of one or two words) looks through the texts that hold any of its terms. Text is read for these only.

The stored index is a set of tables that are kept up batch by batch (see sources.parts): postings, sizes, counts of terms
(replaced documents count negatively), sums, texts and the documents of older parts that newer ones replace.

Defined results: a query without terms, or with terms that no text holds: no rows; a null text: one without terms, which
counts as a text; equal texts: each on its own; scores rounded to 9 places are equal: the smaller chunk_id comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.functions.tokens import lexical_tokens
from tabulora.operators import neighbors
from tabulora.sources.parts import Parts

K1, B = 1.5, 0.75
#: The rarest inner tokens of a query that a text must hold before it is looked into.
SEEDS = 3
#: Texts that are counted at once, texts of a pack, postings that are packed at once, queries of a block, terms of a product,
#: bytes of blocks that may be sent to all executors.
ROWS, PACK, POSTINGS_HELD, BLOCK, SLICE, SHIPPED = 1024, 1024, 1 << 18, 512, 2048, 64 << 20
#: The most that holding the query as a whole adds.
BONUS = 1.0
EPS = 1e-6


@dataclass
class Index:
    """postings (term, chunk_id, doc_id, tf, len); terms (term, df, max_tf, min_len); sums (n, total, full: one row);
    texts (chunk_id, text)."""

    postings: DataFrame
    terms: DataFrame
    sums: DataFrame
    texts: DataFrame


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(lexical_tokens("query"))).alias("term"))


def _counts(batches):
    """The tokens of each text with how often they occur, and '' for each text."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            rb = whole.slice(k, ROWS)
            size = pc.fill_null(pc.list_value_length(rb.column("t")), 0)
            words = pc.list_flatten(rb.column("t")).dictionary_encode()
            n = max(len(words.dictionary), 1)
            each, tf = np.unique(np.repeat(np.arange(rb.num_rows), np.asarray(size)) * n + np.asarray(words.indices), return_counts=True)
            row = pa.array(np.concatenate([each // n, np.arange(rb.num_rows)]))
            term = pa.concat_arrays([words.dictionary.take(pa.array(each % n)), pa.array([""] * rb.num_rows, words.dictionary.type)])
            tf = pa.array(np.concatenate([tf, np.ones(rb.num_rows, int)]), pa.int32())
            yield pa.RecordBatch.from_arrays([rb.column("chunk_id").take(row), rb.column("doc_id").take(row), size.take(row), term, tf], names=["chunk_id", "doc_id", "len", "term", "tf"])


def rows_of(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, doc_id, len, term, tf) of texts (chunk_id, doc_id, text), only of the wanted terms if there are any
    given; a row with the term '' for each text says its length. Each text is counted where it lies."""
    tokens = texts.select("chunk_id", "doc_id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    chunk, doc = (tokens.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id"))
    rows = tokens.mapInArrow(_counts, f"chunk_id {chunk}, doc_id {doc}, len int, term string, tf int")
    if wanted is not None:
        marks = wanted.sparkSession.range(1).select(F.lit("").alias("term"))
        rows = rows.join(wanted.select("term").distinct().union(marks), "term", "left_semi")
    return rows


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def summed(sizes: DataFrame, *keys: str) -> DataFrame:
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.count(F.when(F.col("len") > 0, 1)).alias("full")]
    return sizes.groupBy(*keys).agg(*sums) if keys else sizes.agg(*sums)


def in_memory(texts: DataFrame, wanted: DataFrame) -> tuple[Index, DataFrame]:
    """An index of the wanted terms, made in one pass over the texts, and the sizes (chunk_id, doc_id, len)."""
    rows = cut(rows_of(texts, wanted))
    postings, sizes = rows.where("term <> ''"), rows.where("term = ''").select("chunk_id", "doc_id", "len")
    return Index(postings, counted(postings), summed(sizes), texts.select("chunk_id", "text")), sizes


# ---------------------------------------------------------------- scores
def idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def mean_length() -> Column:
    return F.greatest(F.col("total") / F.greatest("full", F.lit(1)), F.lit(1e-9))


def part(tf: str = "tf", size: str = "len") -> Column:
    """What a term adds to a text, with idf and mean beside it: more for a larger frequency, less for a longer text."""
    f = F.col(tf)
    return F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(size) / F.col("mean")))


def _bound(scored: DataFrame, top_k: int) -> DataFrame:
    """(query_id, bound): the score of each query's text of that rank, where there are as many."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k).where(F.col("_r") == top_k).select("query_id", F.col("score").alias("bound"))


def _parts(terms: DataFrame, postings: DataFrame, *on: str) -> DataFrame:
    """(query_id, chunk_id, score): sums over terms (query_id, term, idf, mean, maybe chunk_id)."""
    hits = terms.join(postings.select("term", "chunk_id", "tf", "len"), ["term", *on])
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part()).alias("score"))


def _packs(batches):
    """Rows of up to PACK texts out of postings that come sorted by text."""

    def packs(rows):
        starts = np.flatnonzero(np.diff(np.asarray(rows.column("chunk_id")), prepend=-1 - np.asarray(rows.column("chunk_id"))[:1]))
        for k in range(0, len(starts), PACK):
            mine = starts[k : k + PACK]
            end = starts[k + PACK] if k + PACK < len(starts) else rows.num_rows
            part = rows.slice(mine[0], end - mine[0])
            words = part.column("term").dictionary_encode()
            at = np.repeat(np.arange(len(mine)), np.diff(np.append(mine, end)))
            first = pa.array(mine - mine[0])
            ids, lens = np.asarray(part.column("chunk_id").take(first)), np.asarray(part.column("len").take(first))
            arrays = [ids, *[np.asarray(x).astype(np.int32) for x in (lens, at, words.indices, part.column("tf"))]]
            yield pa.RecordBatch.from_arrays([pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["terms", "ids", "lens", "at", "code", "tf"])

    held, n = [], 0
    for rb in batches:
        held.append(rb)
        n += rb.num_rows
        if n >= POSTINGS_HELD:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = np.asarray(rows.column("chunk_id"))
            last = int(np.searchsorted(ids, ids[-1]))  # the last text may go on
            if last:
                yield from packs(rows.slice(0, last))
            held, n = [rows.slice(last)], rows.num_rows - last
    if n:
        yield from packs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _scores(rb, i):
    """The scores of a block's queries for a pack's texts."""
    ids, lens, at, code, tf = (np.frombuffer(rb.column(c)[i].as_py(), t) for c, t in (("ids", np.int64), ("lens", np.int32), ("at", np.int32), ("code", np.int32), ("tf", np.int32)))
    query_ids, lists = np.asarray(rb.column("q_ids")[i].values), rb.column("q_terms")[i].values
    flat = lists.flatten()
    query = np.repeat(np.arange(len(query_ids)), np.asarray(pc.list_value_length(lists)))
    known = pc.index_in(flat.field("term"), value_set=rb.column("terms")[i].values)
    of = np.asarray(pc.fill_null(known, -1))
    idf, query, of = np.asarray(flat.field("idf"))[of >= 0], query[of >= 0], of[of >= 0]
    used, col = np.unique(of, return_inverse=True)  # the pack's terms that the block asks for
    place = np.full(len(rb.column("terms")[i].values), -1)
    place[used] = np.arange(len(used))
    term = place[code]
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[at] / rb.column("mean")[i].as_py()))
    s = np.zeros((len(query_ids), len(ids)))
    for k in range(0, len(used), SLICE):
        n = min(SLICE, len(used) - k)
        asked, held = np.zeros((len(query_ids), n)), np.zeros((n, len(ids)))
        inside = (col >= k) & (col < k + n)
        asked[query[inside], col[inside] - k] = idf[inside]
        inside = (term >= k) & (term < k + n)
        held[term[inside] - k, at[inside]] = value[inside]
        s += asked @ held
    yield query_ids, ids, s, 0


def _scored(heads: DataFrame, postings: DataFrame, top_k: int) -> DataFrame:
    """(query_id, chunk_id, score): the best of each query of heads (query_id, terms: array of (term, idf), mean)."""
    size = heads.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0)).alias("terms")).first()
    rows = heads.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(size.n // BLOCK + 1)).alias("_b"))
    of = rows.agg(F.collect_list(F.struct("query_id", "terms")).alias("q"), F.max("mean").alias("mean"))
    of = of.select(F.transform("q", lambda x: x.query_id).alias("q_ids"), F.transform("q", lambda x: x.terms).alias("q_terms"), "mean")
    of = F.broadcast(of) if size["terms"] * 64 <= SHIPPED else of
    packs = postings.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(_packs, "terms array<string>, ids binary, lens binary, at binary, code binary, tf binary")
    hits = packs.crossJoin(of).mapInArrow(neighbors.kept(top_k, _scores), "query_id long, chunk_id long, score double")
    return neighbors.ranked(hits, top_k).select("query_id", "chunk_id", "score")


#: Inner tokens: a text that holds the query holds these as tokens of its own. Words with something before and after that ends
#: a word, pairs and triples of CJK characters (a run as a whole may go on in the text).
_INNER = r"(?<=[^a-z0-9._/-])[a-z0-9][a-z0-9._/-]*(?=[^a-z0-9._/-])"


def _whole(queries: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id): texts that hold the query as a whole and at least one of its terms."""
    words = F.regexp_extract_all(F.lower("query"), F.lit(_INNER), F.lit(0))
    runs = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[一-鿿]+"), F.lit(0)), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    # only what the query has as a term: stop words are none
    inner = F.array_intersect(F.concat(words, pairs), lexical_tokens("query"))
    asked = cut(queries.where("query is not null").select("query_id", inner.alias("inner")).join(terms.select("query_id").distinct(), "query_id", "left_semi"))
    counts = asked.select("query_id", F.explode("inner").alias("term")).join(index.terms.where("df > 0").select("term", "df"), "term", "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    # the rarest ones; a query with one that no text holds is left with a count that no text reaches
    rarest = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SEEDS).select("query_id", "term")
    single = asked.where("size(inner) = 0").select("query_id").join(terms.select("query_id", "term"), "query_id")
    looked = cut(rarest.withColumn("need", F.count("*").over(Window.partitionBy("query_id"))).unionByName(single.withColumn("need", F.lit(1).cast("long"))))
    found = looked.join(index.postings.select("term", "chunk_id"), "term").groupBy("query_id", "chunk_id", "need").agg(F.count("*").alias("have")).where("have >= need")
    pairs = found.select("query_id", "chunk_id").join(queries.select("query_id", "query"), "query_id").join(index.texts, "chunk_id")
    return pairs.where(F.contains("text", "query")).select("query_id", "chunk_id").distinct()


def search(queries: DataFrame, index: Index, top_k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the top_k texts of each query (query_id, query) over all texts of the index."""
    of_query, of_text = queries.schema["query_id"].dataType, index.postings.schema["chunk_id"].dataType
    terms = query_terms(queries).join(index.terms, "term").where("df > 0").crossJoin(F.broadcast(index.sums))
    # a row for each term of a query
    terms = cut(terms.select("query_id", "term", idf().alias("idf"), mean_length().alias("mean")))
    sets = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"), F.max("mean").alias("mean"))
    sets = cut(sets.withColumn("head", F.min("query_id").over(Window.partitionBy("terms"))))
    postings = index.postings.select("term", "chunk_id", "tf", "len").where("chunk_id is not null").join(terms.select("term").distinct(), "term", "left_semi")
    best = _scored(sets.where("query_id = head").select(F.col("query_id").cast("long"), "terms", "mean"), postings.withColumn("chunk_id", F.col("chunk_id").cast("long")), top_k)
    best = best.withColumnRenamed("query_id", "head").join(sets.select("query_id", F.col("head").cast("long")), "head").select("query_id", F.col("chunk_id").cast(of_text), "score")
    whole = cut(_whole(queries, terms, index).join(terms, "query_id"))
    whole = _parts(F.broadcast(whole) if whole.count() * 64 <= SHIPPED else whole, index.postings, "chunk_id")
    both = best.unionByName(whole.select("query_id", "chunk_id", (F.col("score") + BONUS).alias("score")))
    both = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return both.select(F.col("query_id").cast(of_query), "chunk_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def finished(queries: DataFrame, scored: DataFrame, texts: DataFrame, top_k: int) -> DataFrame:
    """The top_k of each query after the extra point for texts that hold it; only texts that it can lift are read."""
    scored = cut(scored.where("score > 0"))
    close = scored.join(_bound(scored, top_k), "query_id", "left").where(F.col("bound").isNull() | (F.col("score") + BONUS >= F.col("bound") - EPS))
    close = close.select("query_id", "chunk_id", "score").join(queries.select("query_id", "query"), "query_id").join(texts, "chunk_id")
    close = close.select("query_id", "chunk_id", (F.col("score") + F.when(F.contains("text", "query"), BONUS).otherwise(0.0)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


# ---------------------------------------------------------------- stored
POSTINGS = "term string, chunk_id bigint, doc_id bigint, tf int, len int"
SIZES = "chunk_id bigint, doc_id bigint, len int"
TERMS = "term string, df bigint, max_tf int, min_len int"
SUMS = "n bigint, total bigint, full bigint"
TEXTS = "chunk_id bigint, doc_id bigint, text string"
REPLACED = "doc_id bigint, dead string"


class StoredIndex:
    """An index in a folder. A batch of texts takes the place of all earlier texts of its documents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.parts = spark, Parts(spark, path)

    def _live(self, name: str, schema: str, parts: list[dict]) -> DataFrame:
        """Rows whose document no later part replaces."""
        gone = self.parts.read("replaced", REPLACED, parts).select("doc_id", F.col("dead").alias("part")).distinct()
        return self.parts.read(name, schema, parts).join(gone, ["doc_id", "part"], "left_anti")

    def add(self, texts: DataFrame) -> None:
        """Adds texts (chunk_id, doc_id, text). Two writers cannot replace the same documents unseen: the one that ends
        last fails with Conflict and may try again."""
        base, parts = self.parts.live()
        rows = cut(rows_of(texts.select(F.col("chunk_id").cast("long"), F.col("doc_id").cast("long"), "text")))
        postings, sizes = rows.where("term <> ''").select("term", "chunk_id", "doc_id", "tf", "len"), rows.where("term = ''").select("chunk_id", "doc_id", "len")
        ids = sizes.select("doc_id").distinct()
        old = self._live("sizes", SIZES, parts).join(ids, "doc_id", "left_semi")
        # what goes is taken off the counts; the largest frequency and least length stay as bounds
        lost = self._live("postings", POSTINGS, parts).join(ids, "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
        none = F.lit(None).cast("int")
        terms = counted(postings).unionByName(lost.select("term", "df", none.alias("max_tf"), none.alias("min_len")))
        sums = summed(sizes).union(summed(old).select(-F.col("n"), -F.col("total"), -F.col("full")))
        self.parts.add({
            "postings": postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"),
            "sizes": sizes, "terms": terms, "sums": sums, "texts": texts.select(F.col("chunk_id").cast("long"), F.col("doc_id").cast("long"), "text"),
            "replaced": old.select("doc_id", F.col("part").alias("dead")).distinct(),
        }, base=base)

    def compact(self) -> None:
        """Writes all that holds as one part, with exact bounds."""
        base, parts = self.parts.live()
        postings = cut(self._live("postings", POSTINGS, parts).drop("part"))
        sizes, texts = (self._live(n, s, parts).drop("part") for n, s in (("sizes", SIZES), ("texts", TEXTS)))
        order = postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        self.parts.add({"postings": order.select("term", "chunk_id", "doc_id", "tf", "len"), "sizes": sizes, "terms": counted(postings), "sums": summed(sizes), "texts": texts.select("chunk_id", "doc_id", "text")}, replace=True, base=base)

    def index(self) -> Index:
        """What holds now."""
        _, parts = self.parts.live()
        terms = self.parts.read("terms", TERMS, parts).groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        sums = self.parts.read("sums", SUMS, parts).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "full")])
        postings = self._live("postings", POSTINGS, parts).select("term", "chunk_id", "doc_id", "tf", "len")
        return Index(postings, terms, sums, self._live("texts", TEXTS, parts).select("chunk_id", "text"))

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        return search(queries, self.index(), top_k)

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        return self.parts.vacuum(keep, hours)
