"""Search with bounds against scoring of everything, and tables that are kept up part by part."""

import math
import random
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabulora.operators import postings
from tabulora.operators.postings import StoredIndex
from tabulora.sources import tables
from tabulora.sources.parts import Conflict, Parts

TEXT, ASK = "chunk_id long, doc_id long, text string", "query_id long, query string"


def tokens(t):
    return re.findall("[a-z0-9][a-z0-9._/-]*", (t or "").lower())


def plain(asked, texts, k):
    bag = {c: Counter(tokens(t)) for c, _, t in texts}
    n, total, full = len(texts), sum(map(Counter.total, bag.values())), sum(1 for b in bag.values() if b)
    mean = max(total / max(full, 1), 1e-9)
    df = Counter(w for b in bag.values() for w in b)
    out = set()
    for q, ask in asked:
        scores = {}
        for c, _, t in texts:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[c][w] * 2.5 / (bag[c][w] + 1.5 * (0.25 + 0.75 * bag[c].total() / mean)) for w in set(tokens(ask)) if bag[c][w])
            if s > 0:
                scores[c] = s + (ask in (t or ""))
        best = sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:k]
        out |= {(q, c, i + 1, round(scores[c], 6)) for i, c in enumerate(best)}
    return out


def got(df):
    return {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in df.collect()}


def corpus(seed, n=150):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda a, b: " ".join(r.choices(words, weights, k=r.randint(a, b)))
    texts = [(k, k // 2, text(0, 40)) for k in range(n)] + [(900, 900, None), (901, 901, ""), (902, 902, "w0 " * 500)]
    asked = [(k, text(1, 12)) for k in range(25)] + [(50, texts[3][2]), (51, "w0"), (52, "w0 w1"), (53, "nowhere"), (54, ""), (55, "w1 w59 w58")]
    return texts, asked


@pytest.mark.parametrize(("seeds", "k"), [(1, 1), (2, 3), (20, 5), (1, 400)])
def test_search_equals_scoring_everything(spark, monkeypatch, seeds, k):
    monkeypatch.setattr(postings, "SEEDS", seeds)
    texts, asked = corpus(seeds)
    q, t = spark.createDataFrame(asked, ASK), spark.createDataFrame(texts, TEXT).repartition(3)
    index, sizes = postings.in_memory(t, postings.query_terms(q))
    assert got(postings.search(q, index, k)) == plain(asked, texts, k)
    assert sizes.count() == len(texts)


def test_bounds_leave_texts_out(spark):
    texts = [(k, k, "the of and " * 5 + (f"rare{k % 40} rare{k % 41} rare{k % 43}")) for k in range(2000)]
    asked = [(1, "the of and rare1 rare2 rare3")]
    q, t = spark.createDataFrame(asked, ASK), spark.createDataFrame(texts, TEXT)
    index, _ = postings.in_memory(t, postings.query_terms(q))
    assert got(postings.search(q, index, 3)) == plain(asked, texts, 3)


def test_queries_of_equal_terms_are_scored_once(spark, monkeypatch):
    scored, seen = postings._scored, []
    monkeypatch.setattr(postings, "_scored", lambda heads, *rest: seen.append(heads.count()) or scored(heads, *rest))
    texts = [(k, k, f"common {'words ' * (k % 5)}") for k in range(300)]
    asked = [(k, f"{k:06d} common") for k in range(40)] + [(99, "words common"), (100, "common words")]
    q, t = spark.createDataFrame(asked, ASK), spark.createDataFrame(texts, TEXT)
    index, _ = postings.in_memory(t, postings.query_terms(q))
    assert got(postings.search(q, index, 3)) == plain(asked, texts, 3)
    assert seen == [2]


def test_whole_queries_are_found_by_inner_tokens(spark):
    texts = ["xcash growthy cash", "cash growth", "growth cash", "x.a-b c d.e d", "x-abc def abc", "a b c", "the a b cd", "in the house d", "within the housed d", "d d"]
    texts = [(k, k, t) for k, t in enumerate(texts)]
    asked = [(1, "cash growth"), (2, "a-b c d"), (3, "-abc def"), (4, "a b c"), (5, "in the house"), (6, "d"), (7, " d"), (8, "nowhere c d"), (9, "c nowhere d")]
    q, t = spark.createDataFrame(asked, ASK), spark.createDataFrame(texts, TEXT)
    index, _ = postings.in_memory(t, postings.query_terms(q))
    assert got(postings.search(q, index, 4)) == plain(asked, texts, 4)


@pytest.mark.parametrize(("held", "pack"), [(1, 1), (3, 2), (7, 3), (1000, 1000)])
def test_texts_stay_whole_in_packs(monkeypatch, held, pack):
    monkeypatch.setattr(postings, "POSTINGS_HELD", held)
    monkeypatch.setattr(postings, "PACK", pack)
    rows = [{"term": f"t{j}", "chunk_id": c, "tf": j + 1, "len": 10 + c} for c in (-5, 2, 3, 9) for j in range(c % 4 + 1)]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 2]) for k in range(0, len(rows), 2)]
    out = []
    for rb in postings._packs(iter(batches)):
        ids, lens, at, code, tf = (np.frombuffer(rb.column(c)[0].as_py(), t) for c, t in (("ids", np.int64), ("lens", np.int32), ("at", np.int32), ("code", np.int32), ("tf", np.int32)))
        terms = rb.column("terms")[0].as_py()
        assert len(ids) <= pack
        out += [{"term": terms[code[k]], "chunk_id": int(ids[at[k]]), "tf": int(tf[k]), "len": int(lens[at[k]])} for k in range(len(at))]
    assert out == rows


def test_search_of_nothing(spark):
    q, t = spark.createDataFrame([(1, "a b")], ASK), spark.createDataFrame([], TEXT)
    index, _ = postings.in_memory(t, postings.query_terms(q))
    assert postings.search(q, index, 3).count() == 0
    index, _ = postings.in_memory(spark.createDataFrame([(1, 1, "a")], TEXT), postings.query_terms(q.limit(0)))
    assert postings.search(q.limit(0), index, 3).count() == 0


def test_stored_index_keeps_up(spark, tmp_path):
    texts, asked = corpus(7, 60)
    q = spark.createDataFrame(asked, ASK)
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    assert index.search(q, 4).count() == 0
    old = [(c, d, "w3 w4 older") for c, d, _ in texts if d % 5 == 0] + [(5000, 5, "w0 gone")]
    index.add(spark.createDataFrame(old, TEXT))
    index.add(spark.createDataFrame(texts[:40], TEXT))
    index.add(spark.createDataFrame(texts[40:], TEXT))
    now = {c: (c, d, t) for c, d, t in old if d not in {x[1] for x in texts}} | {c: (c, d, t) for c, d, t in texts}
    assert got(index.search(q, 4)) == plain(asked, list(now.values()), 4)
    index.compact()
    assert got(index.search(q, 4)) == plain(asked, list(now.values()), 4)
    assert len(index.parts.live()[1]) == 1 and index.vacuum(hours=0) > 0
    index.add(spark.createDataFrame([(1, 0, "w5 new")], TEXT))
    now = [x for x in now.values() if x[1] != 0] + [(1, 0, "w5 new")]
    assert got(index.search(q, 4)) == plain(asked, now, 4)


# ---------------------------------------------------------------- parts
ROW = "id long, name string"


def test_parts_of_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    go = threading.Barrier(2)

    def write(i):
        go.wait()
        Parts(spark, path).add({"a": spark.createDataFrame([(i, "x")], ROW)})

    threads = [threading.Thread(target=write, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    parts = Parts(spark, path)
    assert parts.versions() == [1, 2] and {r.id for r in parts.read("a", ROW).collect()} == {0, 1}


def test_parts_of_lost_jobs_and_conflicts(spark, tmp_path):
    parts = Parts(spark, f"file://{tmp_path}/p")
    one = spark.createDataFrame([(1, "x")], ROW)
    parts.add({"a": one, "b": one})
    one.write.parquet(f"{parts.path}/a/part=lost")  # a job that died before its manifest
    (tmp_path / "p/manifests/2.json").write_text("[{")  # and one that died within it
    parts.WAIT = 0.3
    assert parts.live()[0] == 1 and parts.read("a", ROW).count() == 1
    with pytest.raises(Conflict):
        parts.add({"a": one}, base=0)
    assert parts.add({"a": one}, base=1) == 3
    assert parts.read("a", ROW).count() == 2 and parts.read("b", ROW).count() == 1
    assert parts.vacuum(keep=3) == 0 and parts.vacuum(hours=0) == 1
    assert parts.read("a", ROW).count() == 2 and parts.versions() == [3]


def test_table_appends_without_reading(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", ROW)
    for k in range(3):
        t.append(spark.createDataFrame([(k, "a")], ROW))
    files = [f for f in (tmp_path / "t/rows").rglob("*.parquet")]
    base = t.version()
    t.replace(t.read().where("id > 0"), base=base)
    assert t.read().count() == 2 and len(files) == len([f for f in files if f.exists()])
    with pytest.raises(Conflict):
        t.replace(t.read().limit(0), base=base)
    assert t.read().count() == 2
    t.append(spark.createDataFrame([("b", 9)], "name string, id long"))
    assert {(r.id, r.name) for r in t.read().collect()} == {(1, "a"), (2, "a"), (9, "b")}
