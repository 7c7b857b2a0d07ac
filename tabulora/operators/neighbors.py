"""Nearest vectors for batches of queries: an exact scan, and stored inverted lists of a coarse quantiser.

Vectors are packed into rows of a few thousand, queries into blocks; each pair of a pack and a block is one product of
matrices in a task, which keeps the best of each query over all the packs that it sees, so what is shuffled is a few rows
for each query and task. Queries do not pass through the driver.

The stored index puts every vector into the cell of its nearest centroid. Centroids come from k-means over a bounded
sample (SAMPLE vectors with the least hashes of their ids), at most CELLS of them. A search looks into each query's
nearest cells by an equi-join on the cell and ranks what it finds exactly; with all cells it is the exact scan.

Defined results: null or empty vectors take no part; vectors of another dimension than the query's are skipped; by cosine
also those of length 0; ties after rounding to 9 places go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.sources.parts import Parts

#: Vectors of a pack, queries of a block, bytes of blocks that may be sent to all executors.
PACK, BLOCK, SHIPPED = 2048, 1024, 64 << 20
#: Vectors that k-means sees, most cells, rounds.
SAMPLE, CELLS, ROUNDS = 65536, 4096, 10
#: Queries of a block that are multiplied at once, rows of best hits that a task holds before it hands them on.
TILE, HELD = 128, 1 << 18

PACKED = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])
HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list begins."""
    return np.asarray(col.values).astype(float), np.asarray(col.offsets).astype(np.int64)


def _pack(batches):
    for rb in batches:
        ids, cells = np.asarray(rb.column("id")), np.asarray(rb.column("cell"))
        values, off = _lists(rb.column("v"))
        size = np.diff(off)
        order = np.lexsort((ids, cells, size))
        change = np.flatnonzero((np.diff(size[order]) != 0) | (np.diff(cells[order]) != 0)) + 1
        for part in np.split(order, change):
            n = int(size[part[0]]) if len(part) else 0
            for k in range(0, len(part) if n else 0, PACK):
                at = part[k : k + PACK]
                m = values[off[at][:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array([cells[at[0]]], pa.int32()), pa.array([n], pa.int32()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], schema=PACKED)


def packed(rows: DataFrame, key: str, vector: str, cell: Column | None = None) -> DataFrame:
    """(cell, dim, ids, m): up to PACK vectors of one cell and dimension in a row, as bytes."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    source = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), doubles.alias("v"), (F.lit(0) if cell is None else cell).cast("int").alias("cell"))
    return source.where("size(v) > 0 and not exists(v, x -> x is null)").mapInArrow(_pack, "cell int, dim int, ids binary, m binary")


def blocks(queries: DataFrame, cell: Column | None = None, n: int = 1) -> DataFrame:
    """(q_cell, q_dim, q_ids, q): queries of one cell and dimension, n blocks of them, as arrays."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = queries.where("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)").select("query_id", doubles.alias("v"), (F.lit(0) if cell is None else cell).cast("int").alias("q_cell"))
    rows = rows.groupBy("q_cell", F.size("v").alias("q_dim"), F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("b"))
    return rows.agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("i"), "v")).alias("q")).select("q_cell", "q_dim", F.transform("q", lambda x: x.i).alias("q_ids"), F.flatten(F.transform("q", lambda x: x.v)).alias("q"))


def _best(ids: np.ndarray, chunks: np.ndarray, scores: np.ndarray, top_k: int):
    """The best of each query among some hits."""
    order = np.lexsort((chunks, -np.round(scores, 9), ids))
    ids, chunks, scores = ids[order], chunks[order], scores[order]
    first = np.searchsorted(ids, ids)
    keep = np.arange(len(ids)) - first < top_k
    return ids[keep], chunks[keep], scores[keep]


def kept(top_k: int, scores: Callable):
    """Keeps the best of each query over all the rows of a task. scores(batch, i): for some queries of a row at a time their
    ids, the ids that they meet, the scores as a matrix, and a score that all hits exceed."""

    def run(batches):
        held: list = []
        n_held = 0

        def merged():
            return _best(*[np.concatenate(x) for x in zip(*held, strict=True)], top_k)

        for rb in batches:
            for query_ids, ids, s, over in (tile for i in range(rb.num_rows) for tile in scores(rb, i)):
                if not s.size:
                    continue
                k = min(top_k, len(ids))
                edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                r, c = np.nonzero((s >= edge[:, None] - 1e-8) & (s > over))
                held.append((query_ids[r], ids[c], s[r, c]))
                n_held += len(r)
                if n_held > HELD:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > HELD // 2:  # so many queries that their best fill the space
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in held[0]], schema=HITS)
                        held, n_held = [], 0
            rb = query_ids = ids = s = None  # goes before the next one comes  # noqa: PLW2901
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in merged()], schema=HITS)

    return run


def _products(true_cosine: bool):
    """The scores of a block's queries for a pack's vectors, a tile of TILE queries at a time."""

    def scores(rb, i):
        n = rb.column("dim")[i].as_py()
        ids, x = np.frombuffer(rb.column("ids")[i].as_py(), np.int64), np.frombuffer(rb.column("m")[i].as_py(), np.float64).reshape(-1, n)
        query_ids, q = np.asarray(rb.column("q_ids")[i].values), np.asarray(rb.column("q")[i].values).reshape(-1, n)
        for k in range(0, len(q), TILE):
            part = q[k : k + TILE]
            s = part @ x.T
            if true_cosine:
                size = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                s = np.where(size > 0, s / np.where(size > 0, size, 1), -np.inf)
            yield query_ids[k : k + TILE], ids, s, -np.inf if true_cosine else 0

    return scores


def ranked(scored: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def nearest(queries: DataFrame, vectors: DataFrame, top_k: int, true_cosine: bool = False, block: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the top_k vectors (chunk_id, embedding) for each query (query_id, embedding).

    By dot product with positive scores only, or by cosine with all. Blocks of queries go to all executors while they
    are small (their bytes are counted); more of them meet the packs pair by pair. block: queries of a block.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("values")).first()
    of = blocks(queries, n=size.n // (block or BLOCK) + 1)
    of = F.broadcast(of) if size["values"] * 8 <= SHIPPED else of
    # no equality, which would send all vectors of a dimension to one task
    pairs = packed(vectors, "chunk_id", "embedding").join(of, (F.col("dim") >= F.col("q_dim")) & (F.col("dim") <= F.col("q_dim")))
    return ranked(pairs.select("dim", "ids", "m", "q_ids", "q").mapInArrow(kept(top_k, _products(true_cosine)), "query_id long, chunk_id long, score double"), top_k)


# ---------------------------------------------------------------- inverted lists
VECTORS = "cell int, chunk_id bigint, embedding array<double>"
CENTROIDS = "cell int, center array<double>"


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centers of k-means over a sample, scaled to length 1; at most CELLS rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.where("chunk_id is not null and size(embedding) > 0").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("embedding", lambda x: (x / F.col("size")).cast("double"))
    some = some.withColumn("size", size).where("size > 0").select(array_to_vector(unit).alias("features"))
    model = KMeans(k=max(2, min(cells, CELLS)), seed=seed, maxIter=ROUNDS).fit(cut(some))
    out = np.array(model.clusterCenters())
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _cells(centers: np.ndarray, n: int):
    """The n nearest cells of each vector; none of vectors of another dimension."""

    def run(batches):
        for rb in batches:
            values, off = _lists(rb.column("embedding"))
            fits = np.flatnonzero(np.diff(off) == centers.shape[1])
            found = np.full((rb.num_rows, n), -1)
            if len(fits):
                x = values[off[fits][:, None] + np.arange(centers.shape[1])]
                s = x @ centers.T
                found[fits] = np.argsort(-s, axis=1, kind="stable")[:, :n]
            lists = pa.array([[c for c in row if c >= 0] for row in found.tolist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rb.column("id"), lists], names=["id", "cells"])

    return run


def nearest_cells(rows: DataFrame, key: str, centers: np.ndarray, n: int) -> DataFrame:
    """(key, cell): a row for each of the n nearest cells."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    source = rows.where("embedding is not null and not exists(embedding, x -> x is null)").select(F.col(key).cast("long").alias("id"), doubles.alias("embedding"))
    return source.mapInArrow(_cells(centers, min(n, len(centers))), "id long, cells array<int>").select(F.col("id").alias(key), F.explode("cells").alias("cell"))


class InvertedLists:
    """A stored index of vectors in a folder; batches are added to the cells of the first one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.parts = spark, Parts(spark, path)

    def centers(self) -> np.ndarray | None:
        rows = self.parts.read("centroids", CENTROIDS).orderBy("cell").collect()  # at most CELLS
        return np.array([r.center for r in rows]) if rows else None

    def add(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Adds vectors (chunk_id, embedding). The first batch makes the cells: the square root of its rows, if not given."""
        source = cut(vectors.select(F.col("chunk_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where("chunk_id is not null and size(embedding) > 0"))
        centers, tables, base = self.centers(), {}, None
        if centers is None:
            base = self.parts.live()[0]
            centers = centroids(source, cells or int(source.count() ** 0.5))
            tables["centroids"] = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], CENTROIDS)
        rows = nearest_cells(source, "chunk_id", centers, 1).join(source, "chunk_id").select("cell", "chunk_id", "embedding")
        tables["vectors"] = rows.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
        self.parts.add(tables, base=base)

    def search(self, queries: DataFrame, top_k: int, probes: int, true_cosine: bool = True) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best of each query's `probes` nearest cells."""
        centers = self.centers()
        if centers is None:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        at = nearest_cells(queries, "query_id", centers, probes).join(queries.select(F.col("query_id").cast("long"), "embedding"), "query_id")
        of = blocks(at, F.col("cell"), n=queries.count() // BLOCK + 1)
        vectors = packed(self.parts.read("vectors", VECTORS), "chunk_id", "embedding", F.col("cell"))
        pairs = vectors.join(of, (F.col("cell") == F.col("q_cell")) & (F.col("dim") == F.col("q_dim")))
        return ranked(pairs.select("dim", "ids", "m", "q_ids", "q").mapInArrow(kept(top_k, _products(true_cosine)), "query_id long, chunk_id long, score double"), top_k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact hits that were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
