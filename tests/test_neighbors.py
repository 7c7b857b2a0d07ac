"""Nearest vectors by packs and blocks, and by stored inverted lists, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulora.operators import neighbors, retrieve

V, Q = "chunk_id long, embedding array<double>", "query_id long, embedding array<double>"


def plain(queries, vectors, k, cosine):
    out = set()
    for q, a in queries:
        hits = []
        for c, b in vectors:
            if c is None or not a or not b or len(a) != len(b):
                continue
            s = float(np.dot(a, b))
            if cosine:
                size = np.linalg.norm(a) * np.linalg.norm(b)
                if size == 0:
                    continue
                s /= size
            elif s <= 0:
                continue
            hits.append((-round(s, 9), c))
        out |= {(q, c, i + 1) for i, (_, c) in enumerate(sorted(hits)[:k])}
    return out


def got(df):
    return {(r.query_id, r.chunk_id, r["rank"]) for r in df.collect()}


@pytest.fixture
def rows():
    r = np.random.default_rng(4)
    vectors = [(k, r.integers(-3, 4, 5).tolist()) for k in range(300)] + [(k, r.normal(size=3).tolist()) for k in range(300, 320)] + [(400, []), (401, None), (402, [0.0] * 5), (None, [1.0] * 5)]
    queries = [(k, r.integers(-3, 4, 5).tolist()) for k in range(40)] + [(50, r.normal(size=3).tolist()), (51, None), (52, [0.0] * 5), (53, [1.0])]
    floats = lambda v: None if v is None else [float(x) for x in v]
    return [(i, floats(v)) for i, v in queries], [(i, floats(v)) for i, v in vectors]


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize(("pack", "block", "shipped", "held"), [(2048, 1024, 64 << 20, 1 << 20), (7, 3, 0, 50)])
def test_nearest_equals_loops(spark, rows, monkeypatch, cosine, pack, block, shipped, held):
    for name, value in (("PACK", pack), ("BLOCK", block), ("SHIPPED", shipped), ("HELD", held)):
        monkeypatch.setattr(neighbors, name, value)
    q, v = spark.createDataFrame(rows[0], Q), spark.createDataFrame(rows[1], V).repartition(3)
    assert got(neighbors.nearest(q, v, 6, cosine)) == plain(*rows, 6, cosine)
    assert retrieve.nearest(q.limit(0), v, 2).count() == 0 and neighbors.nearest(q, v.limit(0), 2).count() == 0


def test_inverted_lists(spark, tmp_path):
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 16)) * 3
    vectors = [(k, (centers[k % 12] + r.normal(size=16) * 0.5).tolist()) for k in range(900)]
    queries = [(k, (centers[k % 12] + r.normal(size=16) * 0.5).tolist()) for k in range(30)]
    q, v = spark.createDataFrame(queries, Q), spark.createDataFrame(vectors, V)
    index = neighbors.InvertedLists(spark, f"file://{tmp_path}/v")
    assert index.search(q, 3, 2).count() == 0
    index.add(v.where("chunk_id < 600"), cells=12)
    index.add(v.where("chunk_id >= 600"))
    exact = neighbors.nearest(q, v, 10, true_cosine=True)
    assert got(index.search(q, 10, probes=99)) == got(exact) == plain(queries, vectors, 10, True)
    few = index.search(q, 10, probes=3)
    assert neighbors.recall(few, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert index.parts.read("vectors", neighbors.VECTORS).count() == 900 and len(index.centers()) == 12


def test_few_queries_are_multiplied_at_once():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(600, 8)), rng.normal(size=(500, 8))
    row = {"dim": 8, "ids": np.arange(600).tobytes(), "m": x.tobytes(), "q_ids": list(range(500)), "q": q.ravel().tolist()}
    products, sizes = neighbors._products(False), []

    def watched(rb, i):
        for tile in products(rb, i):
            sizes.append(tile[2].size)
            yield tile

    out = pa.Table.from_batches(list(neighbors.kept(5, watched)(iter([pa.RecordBatch.from_pylist([row])]))))
    got = {(r["query_id"], r["chunk_id"]) for r in out.to_pylist()}
    assert got == {(k, int(c)) for k, s in enumerate(q @ x.T) for c in np.argsort(-s)[:5]}
    assert max(sizes) <= neighbors.TILE * 600 and len(sizes) == 4
