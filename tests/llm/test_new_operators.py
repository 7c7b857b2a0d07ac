"""Spelling variants, fill-in-the-middle and the quality classifier against plain versions and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabulora.llm import infill, quality, spelling

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
WIDE = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("id", StringType()), StructField("n", StringType()), StructField("word", StringType())])


# ---------------------------------------------------------------- spelling
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, typos=97):
    words = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % typos == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            words[w] += 1
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    rows, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v)) if others else None
        form[w] = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (n, len(others))
    out = set()
    for w, (n, k) in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, k, words[form[w]] if form[w] is not None else None))
    return out


def got_variants(spark, rows, schema=DOC, **options):
    d = spelling.variants(spark.createDataFrame(rows, schema).repartition(3), typos=97, **options)
    return {tuple(r) for r in d.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abÀßÿc") for _ in range(r.randint(4, 7))) for _ in range(25)]
    words = base + [w[:k] + r.choice("abÿ") + w[k + r.randint(0, 1) :] for w in base for k in range(4)]
    docs = [(k, " ".join(r.choice(words[: 1 + k]).title() + r.choice([" ", ", ", "9", "\n", "é漢"]) for _ in range(60))) for k in range(80)]
    docs += [(80, None), (81, ""), (None, " ".join(words) * 2), (3, docs[3][1]), (3, "other text " * 5), (82, "Łabcdłabcd " * 3 + "abcde" * 40)]
    want = plain_variants(docs)
    assert len(want) > 30 and any(x[1] for x in want) and len({x[2] for x in want}) < len(want)
    assert got_variants(spark, docs) == want


def test_variants_of_a_frequent_word_and_chains(spark):
    docs = [(k, "abcdef " * 40) for k in range(30)] + [(40, "abcdex " * 500 + "abcdxx " * 200 + "abcxxx " * 90 + "abxxxx " * 3 + "zbcdef " * 3)]
    assert got_variants(spark, docs) == plain_variants(docs)
    # ties go to the first in code-point order
    tie = [(k, "abcdé abcdÿ abcdz abcdé abcdÿ abcdz ") for k in range(9)] + [(99, "abcda " * 3)]
    assert got_variants(spark, tie) == plain_variants(tie)


def test_variants_of_odd_tables(spark):
    assert got_variants(spark, []) == set()
    assert got_variants(spark, [(1, None), (2, ""), (None, None), (3, "漢字 123 \u0000")]) == set()
    wide = [(k, "banana bananas bananas", "x", "y", "z") for k in range(9)]
    assert got_variants(spark, wide, WIDE) == plain_variants([r[:2] for r in wide])
    long = "q" * 3000
    docs = [(k, f"{long} {long}r") for k in range(3)] + [(7, f"{long} " * 9)]
    assert got_variants(spark, docs) == plain_variants(docs)


def test_neighbourhood_is_full_and_without_repeats():
    alphabet = np.frombuffer(b"abc", np.uint8)
    for n in range(1, 5):
        for w in itertools.product(b"abc", repeat=n):
            made = [bytes(m) for _, rows in spelling.edits(np.array([w], np.uint8), alphabet, lambda h: np.ones(len(h), bool)) for m in rows]
            own = bytes(w)
            want = {own[:i] + own[i + 1 :] for i in range(n)} | {own[:i] + bytes([c]) + own[i + k :] for i in range(n + 1) for c in b"abc" for k in (0, 1) if i + k <= n}
            assert len(made) == len(set(made))
            assert set(made) == want - {own, b""}


# ---------------------------------------------------------------- infill
def plain_infill(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def some_texts():
    r = random.Random(3)
    pieces = ["word", "É", "漢", " ", "\n", "<", "<P", "\\", "😀", "A", ".", "\x00", "longerword"]
    docs = [(k, "".join(r.choice(pieces) for _ in range(r.choice([0, 1, 2, 5, 63, 64, 65, 500])))) for k in range(300)]
    return docs + [(None, "no id here, none"), (5, None), (6, ""), (7, "with <M> mark"), (8, "a" * 5000), (8, "é" * 5000), (8, "é" * 5000)]


def test_infill_equals_plain_version(spark):
    docs = some_texts()
    out = infill.fill_in_middle(spark.createDataFrame(docs, DOC).repartition(5))
    got = out.withColumn("back", infill.restored(out.form, out.output)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain_infill(*d) for d in docs), key=repr)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("every", "piece"), [(1, 7), (3, 1), (64, 1 << 18), (5, 64)])
def test_cuts_by_checkpoints(every, piece):
    texts = [(t or "").encode() for _, t in some_texts()[:60]] + [b"", "aé".encode() * 50, b"", b"x"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    index = infill.Index(data, off, every, piece)
    for row, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t.decode())
        assert index.first_unit[row + 1] - index.first_unit[row] == len(units)
        for k in {0, len(units), len(units) // 2, len(units) // 3}:
            byte, point = index.cut(row, k)
            before = "".join(units[:k])
            assert (byte - off[row], point - index.first_point[row]) == (len(before.encode()), len(before))
    assert len(index.at) <= len(data) // every + 2 * len(texts) + 2


def test_infill_of_odd_tables(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], DOC)).count() == 0
    out = infill.fill_in_middle(spark.createDataFrame([(1, "some words here", "a", "b", "c")], WIDE)).collect()
    assert tuple(out[0]) == plain_infill(1, "some words here")


# ---------------------------------------------------------------- quality
def test_marginals_by_enumeration():
    r = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    bad, move = r.normal(size=11), r.normal(size=(2, 2))
    p, pairs = quality.marginals(bad, move, first)
    want, both = np.zeros(11), np.zeros((2, 2))
    for a, b in itertools.pairwise(first.tolist()):
        total, mass, cells = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(bad[a + k] / 2 * (1 if v else -1) for k, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y)))
            total += s
            mass += s * np.array(y)
            for u, v in itertools.pairwise(y):
                cells[u, v] += s
        if b > a:
            want[a:b] = mass / total
            both += cells / total
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_chain_is_fitted_to_the_likelihood():
    r = np.random.default_rng(2)
    first = np.arange(0, 41, 4)
    x = np.concatenate([np.ones((40, 1)), r.normal(size=(40, 2))], axis=1)
    tags = (x[:, 1] + r.normal(size=40) > 0).astype(int)
    w, move = quality.fit_chain(x, tags, first)

    def loss(w, move):
        out = 0.0
        for a, b in itertools.pairwise(first.tolist()):
            z = 0.0
            for y in itertools.product((0, 1), repeat=b - a):
                s = sum((x[a + k] @ w) / 2 * (1 if v else -1) for k, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y))
                z += np.exp(s)
                if y == tuple(tags[a:b]):
                    out -= s
            out += np.log(z)
        return out / 40 + quality.RIDGE / 2 * ((w**2).sum() + (move**2).sum())

    base = loss(w, move)
    for k in range(3):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(3)[k], move) > base - 1e-3
    for k in range(4):
        assert loss(w, move + (0.05 * np.eye(4)[k]).reshape(2, 2)) > base - 1e-3


def test_line_features_of_lines():
    text = "One two two\n\n   \nABC!! DEF!!\nOne two two\nx | y | 12".encode()
    x, size, first = quality.line_features(np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]))
    assert first.tolist() == [0, 4, 4] and size.tolist() == [11, 11, 11, 10]
    assert x[:, 7].round(3).tolist() == [0.333, 0, 0.333, 0.2] and x[:, 8].round(3).tolist() == [0.333, 0, 0.333, 0]
    assert x[:, 9].tolist() == [0, 0, 1, 0] and x[1, 5] == 1 and x[3, 6] == 0.4 and x[3, 2] == 0.2


def quality_docs(n):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    line = lambda bad: " ".join(word() + ("%%%" if bad else "") for _ in range(r.randint(4, 12))) + "."
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        docs.append((k, "\n".join([line(bad) for _ in range(r.randint(1, 6))] + [line(False)] * (k % 3 == 0))))
        labels.append((k, int(not bad)))
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = quality_docs(240)
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, docs[0][1]), (1002, docs[0][1] + "\n" + docs[1][1] * 2000), (1003, " \n ")], DOC).repartition(3)
    model = quality.fit(d, spark.createDataFrame([x for x in labels if x[0] < 160], "doc_id long, quality int"))
    got = {(r.id, r.score): r for r in quality.score(d, model).collect()}
    by_id = {r.id: r for r in got.values()}
    assert all((by_id[k].score >= 0.5) == bool(y) for k, y in labels if k >= 160)
    # the one good line of a bad document is told from the bad ones
    mixed = next(r for k, r in by_id.items() if k is not None and k < 240 and k % 12 == 0 and len(r.lines) > 2)
    assert mixed.lines[0] > 0.5 > mixed.lines[-1]
    assert by_id[1000].score == by_id[1001].score == by_id[1003].score == model.prior and by_id[None].score == by_id[0].score
    assert by_id[1002].score > 0.5 and len(got) == 245


def test_quality_without_labels_and_on_odd_tables(spark):
    docs, labels = quality_docs(12)
    d = spark.createDataFrame(docs, DOC)
    assert quality.fit(d, spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")) is None
    assert {r.score for r in quality.score(d, None).collect()} == {0.0}
    repeated = [*labels, *labels, (0, 1), (None, 0), (3, None)]
    model = quality.fit(d.union(d), spark.createDataFrame(repeated, "doc_id long, quality int"))
    assert quality.score(spark.createDataFrame([], DOC), model).count() == 0
    wide = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in docs], WIDE)
    assert quality.score(wide, model).count() == 12
