"""Each operator against a plain version, on random texts with copies and on rows that are odd in every way."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulora.llm import archive, bpe, common, conversations, decontaminate, fingerprints, jaccard, lm, substrings, toxicity, urls

SCHEMA = "doc_id long, text string, id int, h string, n double, key string, at string, part string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def random_docs(seed=1, n=60):
    """(doc_id, text): random texts, copies, near copies, shared passages, empty, null, one long."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "数据", "x1", "end."] + ["".join(r.choices("abcdefg", k=r.randint(2, 6))) for _ in range(300)]
    text = lambda k: r.choice([" ", "\n", "  "]).join(r.choices(vocabulary, k=k))
    docs, passage = [], text(40)
    for i in range(n):
        kind = i % 6
        if kind == 1 and docs:
            t = r.choice(docs)
        elif kind == 2 and docs:
            w = r.choice(docs).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif kind == 3:
            t = text(r.randint(1, 30)) + " " + passage + " " + text(5)
        else:
            t = text(r.choice([1, 2, 3, 12, 13, 14, 60, 200]))
        docs.append(t)
    docs += ["", None, text(4000), "A", "a", "\t \n", "word" * 3000]
    return list(enumerate(docs))


def frame(spark, docs):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "h", 1.5, "k", "at", "p") for i, t in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return random_docs()


@pytest.fixture(scope="module")
def df(spark, docs):
    return frame(spark, docs).cache()


def rows(out, key="id"):
    return {r[key]: r for r in out.collect()}


# ---------------------------------------------------------------- common
def test_words_and_hashes_do_not_depend_on_the_batch():
    texts = [b"a bb  ccc", b"", b"bb a", "é ü".encode(), b"   ", b"x" * 50]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, e, tok = common.find_words(data, off)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(s, e, strict=True)] == [w for t in texts for w in t.split()]
    assert np.diff(tok).tolist() == [len(t.split()) for t in texts]
    h = common.word_hashes(data, s, e)
    alone = [common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for t in texts for w in t.split()]
    assert h.tolist() == alone and h[0] == h[4] and h[1] == h[3]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bitmap = common.key_filter(keys, "k", 5000)
    mine = np.array([r.k for r in keys.collect()], np.int64)
    assert common.in_filter(bitmap, mine).all()
    assert common.in_filter(bitmap, np.arange(10**6, 10**6 + 5000) * 2654435761).mean() < 0.2


# ---------------------------------------------------------------- 1
def test_fingerprints(df, docs):
    got = rows(fingerprints.edited_fingerprints(df))
    texts = [t or "" for _, t in docs]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        chunks = lambda f: {f[k : k + 12] for k in range(0, len(f), 12)}
        weight = lambda s: sum(int(c[10:], 16) for c in s)
        own, ed, nx = chunks(got[i].fingerprint), chunks(got[i].edited_fingerprint), chunks(got[(i + 1) % len(texts)].fingerprint)
        like = lambda a, b: weight(a & b) / weight(a) if a else float(not b)
        assert got[i].near_edited == pytest.approx(like(own, ed)) and got[i].near_next == pytest.approx(like(own, nx))
    by_text = collections.defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert 0.4 < got[62].near_edited < 0.6  # long text: half is kept


def test_chunks_shift_with_the_text():
    r = random.Random(3)
    t = "".join(r.choices("abcdefgh ", k=4000)).encode()
    cut = lambda x: fingerprints.prints(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
    assert len(np.intersect1d(cut(t), cut(b"some words before " + t))) > 0.9 * len(cut(t))


def test_fingerprints_of_repeated_and_null_ids(spark):
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(None, "first"), (1, "b"), (1, "b"), (1, "c"), (2, None)], "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 1, 1, 1, 5]


# ---------------------------------------------------------------- 2
def test_conversations(spark):
    log = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, 0, None, None), (7, 2, "user", "late"), (7, 1, "user", "early"), (7, 1, "user", "early"), (None, 0, "user", "lost"),
    ]
    rows_ = [(*x, "k", 1, 2) for x in log]
    got = rows(conversations.maximal_conversations(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, k string, x int, y int")), "conv_id")
    assert sorted(got) == [2, 4, 6, 7]
    assert got[2].n_turns == 3 and got[7].rendered == "<|im_start|>user\nearly<|im_end|>\n<|im_start|>user\nlate<|im_end|>\n"
    assert got[6].rendered == "<|im_start|>\n<|im_end|>\n"


# ---------------------------------------------------------------- 3
def shingles(t, k):
    w = WORDS.findall(lower(t or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def classes(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("size", "num", "den", "small"), [(4, 85, 100, 12), (5, 80, 100, 2), (3, 60, 100, 2)])
def test_jaccard(df, docs, size, num, den, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    sets = {i: shingles(t, size) for i, t in docs}
    got = rows(jaccard.similar_classes(df, size=size, num=num, den=den))
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(sets, num, den)


def test_jaccard_links_within_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(8)
    base, places = [f"w{k}" for k in range(160)], [r.randrange(160) for _ in range(30)]
    near = [" ".join(f"x{i}" if k == places[i] else w for k, w in enumerate(base)) for i in range(30)]
    texts = dict(enumerate([*near, *near[:4], *(t for _, t in random_docs(n=20))]))
    members, pairs = jaccard.similar_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=4, num=85, den=100)
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    linked = {(i, j) for i in sets for j in sets if i != j and (both := len(sets[i] & sets[j])) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    first = {i: min([j for j in sets if sets[j] == sets[i]] if sets[i] else [i]) for i in sets}
    assert {(m.id, m.n_shingles, m.class_id, m.n_links) for m in members.collect()} == {(i, len(s), first[i], sum(a == i for a, _ in linked)) for i, s in sets.items()}
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted({(first[i], first[j]) for i, j in linked if first[i] < first[j]}) and len(got) > 100


def test_jaccard_counts_only_what_pivots_lack(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    plain, seen = jaccard.key_filter, []
    monkeypatch.setattr(jaccard, "key_filter", lambda keys, col, n, *rest: seen.append((col, n)) or plain(keys, col, n, *rest))
    r = random.Random(3)
    texts = {i: " ".join(f"x{i}-{k}" if k in gone else f"w{k}" for k in range(160)) for i in range(40) for gone in [set(r.sample(range(160), 2 + i % 5))]}
    got = rows(jaccard.similar_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=4, num=85, den=100))
    assert {i: x.component_id for i, x in got.items()} == classes({i: shingles(t, 4) for i, t in texts.items()}, 85, 100)
    counted = [n for col, n in seen if col == "e"]
    assert counted and counted[1] < 60  # 157 of the whole sets are common


def test_signatures_are_shared_by_all_similar_sets():
    r = np.random.default_rng(5)
    for n in (1, 5, 7, 9, 14, 30, 90, 400):
        for _ in range(8):
            a = r.integers(1, 1 << 62, n).astype(np.uint64)
            drop = r.integers(0, n + 1)
            b = np.concatenate([a[drop // 8 :], r.integers(1, 1 << 62, drop // 9).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 85 * (len(a) + len(b) - both) > 100 * both:
                continue
            h, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sig, row = jaccard.signatures(h, at, 85, 100)
            assert np.intersect1d(sig[row == 0], sig[row == 1]).size, (n, both)
            assert jaccard.cells_apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * both


def test_jaccard_needs_are_met_by_similar_sets_and_not_by_common_passages():
    r = np.random.default_rng(6)
    many = lambda n: r.integers(1, 1 << 62, n).astype(np.uint64)

    def enough(h, at):
        sig, row, of, part, need = jaccard.signatures_and_needs(h, at, 80, 100)
        sig, row = np.array(sorted(set(zip(sig.tolist(), row.tolist(), strict=True))), np.uint64).T
        value, where, times = np.unique(sig, return_inverse=True, return_counts=True)
        row, got = row.astype(np.int64)[times[where] > 1], (sig & np.uint64(jaccard.PART_OF)).astype(np.int64)[times[where] > 1]
        return set(row.tolist()), [(int(i), int(p)) for i, p, n in zip(of, part, need, strict=True) if ((row == i) & (got == p)).sum() >= n]

    for n in (12, 20, 40, 90, 400, 1500):
        for _ in range(12):
            a, gone = many(n), r.integers(0, n // 8 + 1)
            b = np.concatenate([a[gone:], many(r.integers(0, n // 10 + 1))])
            both = len(np.intersect1d(a, b))
            if gone and 80 * (len(a) + len(b) - both) <= 100 * both:
                _, met = enough(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert {i for i, _ in met} == {0, 1}, n
    passage = many(60)
    sets = [np.concatenate([passage, many(400)]) for _ in range(200)]
    some, met = enough(np.concatenate(sets), np.arange(201) * 460)
    assert len(some) > 150 and not met


def test_jaccard_leaves_out_sets_with_a_common_passage_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    plain, seen = jaccard.key_filter, []
    monkeypatch.setattr(jaccard, "key_filter", lambda keys, col, n, *rest: seen.append((col, n)) or plain(keys, col, n, *rest))
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = {i: " ".join(f"x{i}-{k}" for k in range(260)) + " " + passage for i in range(120)}
    texts |= {200 + i: " ".join(f"y{i}" if k == 20 * i + 5 else f"w{k}" for k in range(260)) + " " + passage for i in range(12)}
    got = rows(jaccard.similar_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=4, num=85, den=100))
    assert {i: x.component_id for i, x in got.items()} == classes({i: shingles(t, 4) for i, t in texts.items()}, 85, 100)
    assert [n for col, n in seen if col == "key"] == [12] and "e" not in [col for col, _ in seen]


def test_jaccard_of_odd_rows(spark):
    got = jaccard.similar_classes(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (3, None)], "doc_id long, text string"), size=4, num=85, den=100).collect()
    assert sorted((r.id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 3, 1), (1, 3, 1), (1, 3, 1), (3, 0, 3)]


# ---------------------------------------------------------------- 4
def test_urls(spark):
    pages = [(1, "http://A.Example.ORG/es/x"), (2, "https://example.org/en/12?x"), (3, "http://org"), (4, "ftp://x.com/fr/"), (5, "nothing"), (6, None), (7, "http://b.com/de/1#y"), (8, "http://n.net/a/5"), (9, "http://notorg/a")]
    got = rows(urls.judge(spark.createDataFrame([(*p, "h", "f") for p in pages], "page_id long, url string, host string, form string"), spark.createDataFrame([], "id long, bad int")))
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b.com", "/de/1", "com/de/", "block"), ("n.net", "/a/5", None, "allow"), ("notorg", "/a", None, "allow"),
    ]


def test_url_templates_reject_bad_branches(spark):
    pages = [(k, f"http://s.net/{'ad' if k % 2 else 'news'}/{k}/p{k}-x.html") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 3)], "id long, bad int")
    got = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels))
    assert {(got[k].template.split("/")[1], got[k].verdict) for k in range(400)} == {("ad", "block"), ("news", "allow")}
    assert {got[k].template for k in range(400)} == {"/ad/{n}/*", "/news/{n}/*"}
    alike = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(k, k % 3 % 2) for k in range(400)], "id long, bad int")))
    assert {alike[k].template for k in range(400)} == {"/*/{n}/*"}  # branches that do not differ are merged


def test_url_templates_go_on_to_the_last_segment(spark):
    deep = "/".join("abcdefg")
    pages = [(k, f"http://s.net/2024/05/12/x/{deep}/{'ad' if k % 2 else 'news'}/some-slug-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}") for k in range(400)]
    pages += [(1000, "http://s.net/2024/05/12/x"), (1001, f"http://s.net/2024/05/12/x/{deep}"), (1002, "http://t.net/1/2/3/4/five/six/seven/")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 3)], "id long, bad int")
    got = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels))
    assert len(got) == 403
    assert {(got[k].template, got[k].verdict) for k in range(400)} == {(f"/{{n}}/{{n}}/{{n}}/x/*/b/c/d/e/f/g/{v}/*", j) for v, j in (("ad", "block"), ("news", "allow"))}
    assert [got[k].template for k in (1000, 1001, 1002)] == ["/{n}/{n}/{n}/x", f"/{{n}}/{{n}}/{{n}}/x/*/b/c/d/e/f/g", "/{n}/{n}/{n}/{n}/five/six/seven/"]


# ---------------------------------------------------------------- 5
def test_decontamination_finds_items_with_replaced_words(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(500)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(12, 40)))) for k in range(30)]
    docs, planted = [], set()
    for k, t in items:
        w = t.upper().split()
        for j in range(4, len(w), 9):
            w[j] = "changed"
        docs.append((k, " ".join(r.choices(vocabulary, k=50)) + "\n" + "  ".join(w) + " tail", "key"))
        planted.add((k, k))
    docs += [(100 + k, " ".join(r.choices(vocabulary, k=80)), "key") for k in range(30)] + [(200, None, "k"), (201, "", "k"), (202, items[0][1].split()[0], "k")]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string, key string"), spark.createDataFrame([*items, (99, None), (98, "short item")], "item_id long, text string"))
    found = {(x.id, x.item_id): x for x in got.collect()}
    assert set(found) == planted
    assert all(x.at == 50 and x.n_item == len(items[k[1]][1].split()) for k, x in found.items())


def test_decontamination_is_native_and_joins_when_the_benchmark_is_large(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHIP", 1)
    out = decontaminate.overlaps(docs, bench)
    assert sorted((r.id or -1, r.share) for r in out.collect()) == [(-1, 1.0), (1, 1.0)]
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_masks_meet_every_placement_that_the_rule_accepts():
    for n in range(1, decontaminate.WINDOW + 1):
        places = [{k + j for j, c in enumerate(m) if c == "1"} for m in decontaminate.FAMILIES[n] for k in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontaminate.SHARE)):
            assert any(p.isdisjoint(gone) for p in places), (n, gone)


def test_decontamination_equals_brute_force_over_all_placements(spark):
    r = random.Random(4)
    items, docs = [], []
    for n in [*range(1, 14), 15, 20]:
        w = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        # one word more than the rule lets go is there, too
        few = min(n, 13) - math.ceil(min(n, 13) * 0.75)
        for size in (few, few + 1):
            ways = list(itertools.combinations(range(min(n, 13)), size))
            for gone in ways if size == few else r.sample(ways, min(20, len(ways))):
                changed = ["x" if k in gone or k >= 13 and r.random() < 0.5 else x for k, x in enumerate(w)]
                docs.append((len(docs), " ".join(["y"] * r.randint(0, 3) + changed + ["z"] * r.randint(0, 3))))
    docs += [(9000, "i2w0 i2w1 a i2w0 i2w1 i1w0"), (9001, items[12][1].partition(" ")[2]), (9002, items[12][1].rpartition(" ")[0])]

    def held(text, item):
        d, g = text.split(), item.split()
        window = min(13, len(g))
        best = None
        for shift in range(-len(g) + 1, len(d)):
            same = [int(0 <= shift + j < len(d) and d[shift + j] == x) for j, x in enumerate(g)]
            top = max(sum(same[k : k + window]) for k in range(len(g) - window + 1)) / window
            if top >= 0.75:
                best = max(best or (0.0,), (top, sum(same), -shift))
        return best

    want = {(i, k): b for i, t in docs for k, g in items if (b := held(t, g))}
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.id, x.item_id): (x.share, x.n_equal, -x.at) for x in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- 6
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks(tmp_path_factory):
    """All bytes and some merges, in the form of a rank file."""
    tokens = [bytes([b]) for b in range(256)] + [b"th", b"the", b" t", b" th", b" the", b"ab", b"abc", b"\xc3\xbc", b" a"]
    at = tmp_path_factory.mktemp("ranks") / "ranks"
    at.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    return str(at), tokens


def merged(piece, rank):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not pairs:
            return [rank[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("block", [1, 700, 1 << 20])
def test_bpe(df, docs, ranks, block, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "BLOCK", block)
    path, tokens = ranks
    rank = {t: i for i, t in enumerate(tokens)}
    got = rows(bpe.encode_decode(df, path, PATTERN))
    for i, t in docs:
        want = [x for w in regex.findall(PATTERN, t or "") for x in merged(w.encode(), rank)]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_bpe_equals_the_library_on_public_ranks(df, docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    core = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    got = rows(bpe.encode_decode(df, path, public_tokenizers.PATTERN))
    for i, t in docs:
        want = core.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want) and bytes(got[i].decoded) == (t or "").encode()


def test_bpe_keeps_repeated_rows_and_null_ids(spark, ranks):
    out = bpe.encode_decode(spark.createDataFrame([(1, "the ab")] * 3 + [(None, "the"), (2, None)], "doc_id long, text string"), ranks[0], PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in out) == [b"", b"the", b"the ab", b"the ab", b"the ab"]


def test_bpe_blocks_stay_where_they_lie(df, ranks):
    out = bpe.encode_decode(df, ranks[0], PATTERN)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange ") + plan.count("Exchange(") <= 2


def test_bpe_packs_numbers_in_planes():
    items = [b"", b"ab", bytes(range(256)) * 2]
    assert bpe._unpack_all(bpe._pack_all(items)) == items
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 1, 300)]
    assert bpe._unpack_all(bpe._pack_all(ids, 4), 4) == ids
    codes = np.array([0, 254, 255, 1 << 31, 7], np.uint32)
    assert bpe._unsqueeze(bpe._squeeze(codes)).tolist() == codes.tolist()


# ---------------------------------------------------------------- 7
def test_lm(df, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    training, held = F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1
    got = rows(lm.interpolated_scores(df, training, held))
    end = "\0"
    words = {i: [*WORDS.findall(lower(t or "")), end] for i, t in docs}
    pairs = lambda w: list(zip([end, *w[:-1]], w, strict=True))
    c, b, main, mb, hb = (collections.Counter() for _ in range(5))
    for i, w in words.items():
        if i % 3:
            c.update(w)
            b.update(pairs(w))
            if i % 3 == 1:
                hb.update(pairs(w))
            else:
                main.update(w)
                mb.update(pairs(w))
    n, v, nm, vm = sum(c.values()), len(c), sum(main.values()), len(main)
    weight = {}
    for k in {int(math.log2(main[x])) for x, _ in hb if main[x]}:
        own = [(m, (mb[x, y] / main[x]) / ((main[y] + 1) / (nm + vm + 1))) for (x, y), m in hb.items() if main[x] and int(math.log2(main[x])) == k]
        a = 0.5
        for _ in range(200):
            a = min(max(sum(m * a * r / (a * r + 1 - a) for m, r in own) / sum(m for m, _ in own), 1e-4), 1 - 1e-4)
        weight[k] = a

    def p(x, y):
        one = (c[y] + 1) / (n + v + 1)
        if not c[x]:
            return one
        k = int(math.log2(c[x]))
        a = weight[k] if k in weight else weight[min(weight, key=lambda j: abs(j - k))]
        return a * b[x, y] / c[x] + (1 - a) * one

    for i, w in words.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.training) == (len(w), sum(c[x] > 0 for x in w), n, bool(i % 3))
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert g.score == pytest.approx(sum(math.log10(p(x, y)) for x, y in pairs(w)), rel=2e-3)


def test_lm_of_order_three(df, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    got = rows(lm.interpolated_scores(df, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1, order=3))
    end = "\0"
    words = {i: [end, *WORDS.findall(lower(t or "")), end] for i, t in docs}

    def count(keep):
        """Counts of runs of one, two and three words; the end before a text is context only."""
        out = collections.Counter()
        for i, w in words.items():
            if keep(i):
                for k in (1, 2, 3):
                    out.update(tuple(w[j - k + 1 : j + 1]) for j in range(max(1, k - 1), len(w)))
        return out

    every, main, held = count(lambda i: i % 3), count(lambda i: i % 3 == 2), count(lambda i: i % 3 == 1)

    def p(c, run, weights):
        ones = [m for r, m in c.items() if len(r) == 1]
        out = (c[run[-1:]] + 1) / (sum(ones) + len(ones) + 1)
        for k in (2, 3)[: len(run) - 1]:
            n = c[run[-k:-1]]
            if n and weights[k - 2]:
                near = min(weights[k - 2], key=lambda j: abs(j - int(math.log2(n))))
                out = weights[k - 2][near] * c[run[-k:]] / n + (1 - weights[k - 2][near]) * out
        return out

    weights = [{}, {}]
    for k in (2, 3):
        by = collections.defaultdict(list)
        for r, m in held.items():
            if len(r) == k and main[r[:-1]]:
                by[int(math.log2(main[r[:-1]]))].append((m, main[r] / main[r[:-1]] / p(main, r[1:], weights)))
        for j, own in by.items():
            a = 0.5
            for _ in range(200):
                a = min(max(sum(m * a * x / (a * x + 1 - a) for m, x in own) / sum(m for m, _ in own), 1e-4), 1 - 1e-4)
            weights[k - 2][j] = a
    assert weights[1]
    for i, w in words.items():
        runs = [tuple(w[max(0, j - 2) : j + 1]) for j in range(1, len(w))]
        assert got[i].score == pytest.approx(sum(math.log10(p(every, r, weights)) for r in runs), rel=2e-3)


def test_lm_query_tells_apart_what_only_two_words_before_do(spark, tmp_path):
    texts = [w + " b " + {"a": "c", "d": "e"}[w] for w in "ad" for _ in range(200)]
    held = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs = [(i, t) for i, t in zip((i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2), texts, strict=False)]
    spark.createDataFrame([*docs, (held[0], "a b c"), (held[1], "a b e")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = rows(lm.op7_lm_scoring(spark, f"file://{tmp_path}"), "doc_id")
    assert got[held[0]].score > got[held[1]].score + 1


def test_lm_without_training_rows(spark):
    got = lm.interpolated_scores(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_packing():
    r = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), np.arange(300, dtype=np.uint64)):
        assert (lm.unpack(lm.pack(x)) == x).all() and (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()


# ---------------------------------------------------------------- 8
def test_archive(spark, tmp_path):
    pages = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "u", "ünï"), (2, "http://b/", "<p>same</p>"), (None, "n", "alone")]
    df = spark.createDataFrame([(*p, "a") for p in pages], "page_id long, url string, html string, address string")
    a = archive.write_archive(df, f"file://{tmp_path}/w")
    assert a.payloads.count() == 4
    got = archive.read_records(a).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes, r.payload) for r in got) == [
        (-1, "response", -1, 5, "alone"), (1, "revisit", 2, 11, "<p>same</p>"), (2, "response", -1, 11, "<p>same</p>"), (2, "response", -1, 11, "<p>same</p>"), (3, "revisit", 4, 0, ""), (4, "response", -1, 0, ""), (5, "response", -1, 5, "ünï"),
    ]
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(r.payload.encode()).digest()).decode() for r in got)
    archive.export_warc(a, f"file://{tmp_path}/x")
    import gzip

    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "x").glob("part-*")))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[size : size + 4] == b"\r\n\r\n"
        raw, seen = rest[size + 4 :], seen + 1
    assert seen == len(pages)
    back = archive.read_warc(spark, f"file://{tmp_path}/x").collect()
    full = {r.header: r.payload if r.record_type == "response" else "" for r in got}
    assert len(full) == len(pages) and {r.header: bytes(r.payload).decode() for r in back} == full


def test_warc_files_hold_any_url_and_payload(spark, tmp_path):
    urls = ["http://a/x\u2028WARC-Refers-To: <urn:x-page:77:1> b", "http://a/\u0085WARC-Type: revisit", "http://a/\r\nWARC-Type: revisit\r\n\r\n", "é +%20", "\u2029\n", None]
    texts = ["WARC/1.1\r\nContent-Length: 5\r\n\r\nq\r\n\r\n\r\n\r\n", "\r\n\r\n", "y" * 5_000_000, "", None, "z"]
    pages = [(10 * i + j, u, t) for i, u in enumerate(urls) for j, t in enumerate(texts)]
    a = archive.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    archive.export_warc(a, f"file://{tmp_path}/x")
    got = rows(archive.resolved(common.Work(spark, "t"), archive.read_warc(spark, f"file://{tmp_path}/x")), "page_id")
    lead: dict = {}
    for i, _, t in pages:
        lead[t or ""] = max(lead.get(t or "", 0), i)
    for i, u, t in pages:
        raw = (t or "").encode()
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if lead[t or ""] == i else ("revisit", lead[t or ""])))
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
        assert got[i].url == re.sub("[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u or "")
    assert len(got) == len(pages)


def test_archive_with_a_least_size_and_a_broken_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    a = archive.write_archive(df, f"file://{tmp_path}/w", least=3)
    assert {r.page_id: r.record_type for r in archive.read_records(a).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    bad = a.payloads.withColumn("payload", F.concat("payload", F.lit("!"))).cache()
    bad.count()
    bad.write.mode("overwrite").parquet(f"file://{tmp_path}/b/payloads")
    a.headers.write.parquet(f"file://{tmp_path}/b/headers")
    with pytest.raises(Exception, match="bad payload"):
        archive.read_records(archive.Archive(spark, f"file://{tmp_path}/b")).collect()


# ---------------------------------------------------------------- 9
def brute_chain(chain, emit):
    """log Z and marginals over all paths."""
    n, z, hot = len(emit), 0.0, np.zeros(len(emit))
    for path in range(1 << n):
        y = [path >> k & 1 for k in range(n)]
        s, before = 1.0, 0
        for k, state in enumerate(y):
            s *= chain.step[before, state] * (math.exp(emit[k]) if state else 1.0)
            before = state
        z += s
        hot += s * np.array(y)
    return math.log(z), hot / z


def test_chain_against_all_paths():
    chain = toxicity.Chain(-1.2, -0.7, 0.3, 0.9)
    r = np.random.default_rng(4)
    n = np.array([7, 0, 1, 9, 4])
    places = [[0, 3, 4], [], [0], [8], []]
    weights = [r.normal(size=len(p)) for p in places]
    row = np.repeat(np.arange(5), [len(p) for p in places])
    place = np.array([x for p in places for x in p], np.int64)
    hits = toxicity.Hits(row, place, n, np.arange(len(row)), np.arange(len(row)))
    log_z, marginal = chain.run(hits, np.concatenate(weights))
    k = 0
    for i in range(5):
        emit = np.full(n[i], chain.bias)
        emit[places[i]] += weights[i]
        want, hot = brute_chain(chain, emit)
        assert log_z[i] == pytest.approx(want)
        assert marginal[k : k + len(places[i])] == pytest.approx(hot[places[i]])
        k += len(places[i])


def test_toxicity_learns_words_and_prefixes(spark):
    r = random.Random(6)
    bad, plain = ["idiot", "Scum"], ["".join(r.choices("mnopqrstu", k=r.randint(3, 7))) for _ in range(200)]
    docs = []
    for i in range(600):
        w = r.choices(plain, k=r.randint(5, 60))
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice([*bad, "zeku" + r.choice(plain)])
        docs.append((i, "é " + " ".join(w) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in docs] + [(900, None, "", ""), (901, "", "", ""), (None, "you idiot", "", "")], "doc_id long, text string, score string, spans string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs if i % 5] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    held = [(r_.score >= 0.5, docs[r_.id][2]) for r_ in got if r_.id is not None and r_.id < 600 and r_.id % 5 == 0]
    assert np.mean([a == bool(b) for a, b in held]) > 0.97
    by = {r_.id: r_ for r_ in got}
    assert by[900].score == by[901].score < 0.5 < by[None].score
    assert [(s.start, s.end) for s in by[None].spans] == [(4, 9)]
    text = docs[4][1]
    assert all(re.match("idiot|Scum|zeku", text[s.start : s.end]) for s in by[4].spans) and by[4].spans
    assert toxicity.fit(df, labels.where("toxic = 1")) is None
    assert {r_.score for r_ in toxicity.score(df, None).collect()} == {0.0}
    kept = toxicity.with_score(df, model, name="p")
    assert kept.columns == [*df.columns, "p"] and kept.count() == 603


# ---------------------------------------------------------------- 10
@pytest.mark.parametrize(("window", "base"), [(13, 7), (5, 2), (29, 4), (3, 3), (1, 1)])
def test_substrings(df, docs, window, base):
    words = {i: WORDS.findall(t or "") for i, t in docs}
    first: dict = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    got = rows(substrings.remove_repeats(df, window=window, base=base))
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for k in range(window)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_substrings_of_odd_rows(spark):
    t = " ".join(f"w{k}" for k in range(20))
    rows_ = [(1, t), (1, t), (2, "x " + t), (None, t), (3, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted((r.id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 20, 0), (1, 20, 0), (1, 20, 0), (2, 21, 20), (3, 0, 0)]
    whole = substrings.without_repeats(spark.createDataFrame([(*r, "a", "b") for r in rows_], "doc_id long, text string, at string, _id string")).collect()
    assert {(r.doc_id, r.text) for r in whole} == {(1, t), (2, "x"), (None, t), (3, None)}


# ---------------------------------------------------------------- all
def test_empty_tables(spark, ranks, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        fingerprints.edited_fingerprints(none), jaccard.similar_classes(none), bpe.encode_decode(none, ranks[0], PATTERN), lm.interpolated_scores(none, F.lit(True)), toxicity.score(none, toxicity.fit(none, labels)), substrings.remove_repeats(none),
        substrings.without_repeats(none), decontaminate.overlaps(none, spark.createDataFrame([], "item_id long, text string")), conversations.maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        urls.judge(pages, spark.createDataFrame([], "id long, bad int")), archive.read_records(archive.write_archive(pages, f"file://{tmp_path}/e")),
    ):
        assert out.count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", toxicity.fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)
