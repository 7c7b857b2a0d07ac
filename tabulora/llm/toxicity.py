"""Toxicity by a linear-chain conditional random field over words.

Words are runs of letters, A-Z lower-cased. Features of a word are the word and its prefixes of 3 to 6 bytes. From a
bounded sample of labelled documents (SAMPLE of each label) the features that go with the label form the lexicon (at
most LEXICON, the model's size). Words of toxic sample documents that have a strong lexicon feature are tagged toxic,
all others clean, and a chain with two states is fitted to these tags by gradient ascent: weights of the features, a
bias and the transitions. Words without a lexicon feature only have the bias, so a run of g of them is the g-th power of
one 2 x 2 matrix; forward and backward passes go from hit to hit, for many documents at once, and are exact.

A document's score is a logistic function, fitted on the same sample, of what the marginals give: the probability that
any word is toxic, and the expected number and share of toxic words. Spans are the words whose marginal is 0.5 or more.

Defined results: null or empty text: the score of a text without hits; no labelled rows of either label: score 0 for
all; several labels for an id: the highest; null labels: ignored; text of any length: scored whole; null id: scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import LOWER, as_long, find_words, in_filter, mix, out_batch, rows_of, slices, small_batches, word_hashes

#: Sample documents of each label, most lexicon features, prefix lengths in bytes.
SAMPLE, LEXICON, PREFIXES = 4096, 4096, (3, 4, 5, 6)
#: A feature joins the lexicon with so many toxic documents, standard deviations and log odds; it tags with this share.
SEEN, DEVIATIONS, ODDS, STRONG = 4, 5.0, 2.0, 0.95
STEPS, RATE, DECAY = 120, 0.1, 1e-3
LETTERS = np.ones(256, bool)
LETTERS[97:123] = False
LETTERS[65:91] = False
LETTERS[128:] = False


def features(data, off):
    """Starts, ends, first words of rows, and the features of each word (a row for each kind)."""
    data = LOWER[data]
    starts, ends, tok = find_words(data, off, LETTERS)
    kinds = [word_hashes(data, starts, ends)]
    for k in PREFIXES:
        h = word_hashes(data, starts, np.minimum(starts + k, ends))
        kinds.append(mix(h ^ np.uint64(k)))
    return starts, ends, tok, np.stack(kinds)


COUNTS = pa.schema([("f", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count(batches):
    """Documents with each feature by label, summed over a slice."""
    for rb, data, off in slices(batches):
        _, _, tok, kinds = features(data, off)
        label = np.asarray(rb.column("toxic")).astype(np.int64)
        f, row = kinds.ravel(), np.tile(rows_of(tok), len(kinds))
        order = np.lexsort((row, f))
        f, row = f[order], row[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
        f, y = f[new], label[row[new]]
        f, at = np.unique(f, return_inverse=True)
        toxic = np.bincount(at, y, len(f)).astype(np.int64)
        yield out_batch(COUNTS, as_long(f), toxic, np.bincount(at, minlength=len(f)) - toxic)


class Hits:
    """Words with lexicon features: row, place, a weight for each; rows hold n words."""

    def __init__(self, row, place, n, ids, of):
        self.row, self.place, self.n, self.ids, self.of = row, place, n, ids, of
        self.at = np.searchsorted(row, np.arange(len(n) + 1))


def find_hits(table: np.ndarray, bitmap: np.ndarray, tok, kinds) -> tuple[Hits, np.ndarray]:
    """The hits of words in a sorted lexicon, and the index of each hit's word."""
    words, ids = [], []
    for h in kinds:
        some = np.flatnonzero(in_filter(bitmap, h))
        at = np.minimum(np.searchsorted(table, h[some]), len(table) - 1)
        ok = table[at] == h[some]
        words.append(some[ok])
        ids.append(at[ok])
    words, ids = np.concatenate(words), np.concatenate(ids)
    unique, of = np.unique(words, return_inverse=True)
    row = np.searchsorted(tok, unique, "right") - 1
    return Hits(row, unique - tok[row], np.diff(tok), ids, of), unique


class Chain:
    """States clean and toxic; scores are relative to the path of clean words only, whose score is 0."""

    def __init__(self, bias: float, into: float, out: float, stay: float):
        self.step = np.array([[1.0, np.exp(into)], [np.exp(out), np.exp(stay)]])
        self.plain = self.step * np.array([1.0, np.exp(bias)])
        self.bias = bias
        values, vectors = np.linalg.eig(self.plain)
        order = np.argsort(-values)
        self.values, self.left = values[order], vectors[:, order]
        self.right = np.linalg.inv(self.left)

    def gap(self, g: np.ndarray) -> np.ndarray:
        """The matrices of g plain words, each divided by the g-th power of the largest eigenvalue."""
        ratio = (self.values[1] / self.values[0]) ** g
        first, second = np.outer(self.left[:, 0], self.right[0]), np.outer(self.left[:, 1], self.right[1])
        return first[None] + ratio[:, None, None] * second[None]

    def run(self, hits: Hits, weight: np.ndarray, marginals: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """log Z of each row, and the probability of toxic at each hit."""
        n, at, m = hits.n, hits.at, np.diff(hits.at)
        gaps = hits.place.astype(np.float64)
        inner = np.ones(len(gaps), bool)
        inner[at[:-1][m > 0]] = False
        gaps[inner] -= hits.place[np.flatnonzero(inner) - 1] + 1
        tail = n.astype(np.float64)
        tail[m > 0] -= hits.place[at[1:][m > 0] - 1] + 1
        log_z = n * 0.0 + (n - m) * np.log(self.values[0])
        emit = np.exp(np.clip(self.bias + weight, -30, 30))
        move = self.gap(gaps)
        alpha, beta = np.tile([1.0, 0.0], (len(n), 1)), None
        seen = np.empty((len(gaps), 2))
        order = np.argsort(-m, kind="stable")
        sizes = m[order]
        for k in range(int(m.max()) if len(m) else 0):
            live = order[: np.searchsorted(-sizes, -k, "left")]
            e = at[live] + k
            a = np.einsum("ri,rij,jk->rk", alpha[live], move[e], self.step)
            a[:, 1] *= emit[e]
            total = a.sum(axis=1)
            log_z[live] += np.log(total)
            alpha[live] = seen[e] = a / total[:, None]
        last = self.gap(tail)
        end = np.einsum("ri,rij->r", alpha, last)
        log_z += np.log(end)
        if not marginals:
            return log_z, np.zeros(0)
        beta, out = last.sum(axis=2), np.empty(len(gaps))
        for k in range(int(m.max()) - 1 if len(m) else -1, -1, -1):
            live = order[: np.searchsorted(-sizes, -k, "left")]
            e = at[live] + k
            both = seen[e] * beta[live]
            out[e] = both[:, 1] / both.sum(axis=1)
            b = beta[live].copy()
            b[:, 1] *= emit[e]
            b = np.einsum("rij,jk,rk->ri", move[e], self.step, b)
            beta[live] = b / b.sum(axis=1, keepdims=True)
        return log_z, out


def summary(hits: Hits, log_z: np.ndarray, marginal: np.ndarray) -> np.ndarray:
    """What the score is a function of: 1, P(any toxic word), expected number (log) and share of toxic words."""
    many = np.bincount(hits.row, marginal, len(hits.n))
    return np.stack([np.ones(len(many)), 1 - np.exp(-np.maximum(log_z, 0)), np.log1p(many), np.minimum(1, 20 * many / np.maximum(hits.n, 1))], axis=1)


class Model:
    def __init__(self, table, bitmap, weights, chain, score):
        self.table, self.bitmap, self.weights, self.chain, self.score = table, bitmap, weights, chain, score

    def apply(self, tok, kinds):
        hits, words = find_hits(self.table, self.bitmap, tok, kinds)
        weight = np.bincount(hits.of, self.weights[hits.ids], len(words)) if len(words) else np.zeros(0)
        log_z, marginal = Chain(*self.chain).run(hits, weight)
        x = summary(hits, log_z, marginal) @ self.score
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), hits, words, marginal


def _fit_chain(hits: Hits, tags: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and (bias, into, out, stay) by Adam; the four by differences, the weights by marginals."""
    near = np.zeros(len(tags), bool)
    near[1:] = (hits.row[1:] == hits.row[:-1]) & (hits.place[1:] == hits.place[:-1] + 1)
    stay = int((tags & near & np.concatenate([[False], tags[:-1]])).sum()) if len(tags) else 0
    n_toxic = int(tags.sum())
    gold = np.array([n_toxic, n_toxic - stay, n_toxic - stay, stay], float)
    w, four, scale = np.zeros(n_features), np.array([-4.0, -1.0, 0.0, 0.0]), float(max(1, len(hits.n)))
    target = np.bincount(hits.ids, tags[hits.of].astype(float), n_features)
    m1, m2 = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for t in range(1, STEPS + 1):
        weight = np.bincount(hits.of, w[hits.ids], len(tags))
        log_z, marginal = Chain(*four).run(hits, weight)
        base, slope = log_z.sum(), np.empty(4)
        for k in range(4):
            moved = four.copy()
            moved[k] += 1e-4
            slope[k] = (Chain(*moved).run(hits, weight, False)[0].sum() - base) / 1e-4
        grad = np.concatenate([target - np.bincount(hits.ids, marginal[hits.of], n_features), gold - slope]) / scale - DECAY * np.concatenate([w, four]) / 10
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, four = w + move[:n_features], np.clip(four + move[n_features:], -12, 4)
    return w, four


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - 0.1 * b)
    return b


SPARSE = pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("place", pa.list_(pa.int32())), ("f", pa.list_(pa.int32()))])


def _sparse(table, bitmap):
    """Of each sample document only the number of words and its hits."""

    def run(batches):
        for rb, data, off in slices(batches):
            _, _, tok, kinds = features(data, off)
            hits, _ = find_hits(table, bitmap, tok, kinds)
            order = np.argsort(hits.of, kind="stable")
            place, ids, row = hits.place[hits.of][order], hits.ids[order], hits.row[hits.of][order]
            cut = np.searchsorted(row, np.arange(rb.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32())) for v in (place, ids)]
            yield out_batch(SPARSE, rb.column("toxic").cast(pa.int64()), hits.n, *lists)

    return run


def make_filter(table: np.ndarray) -> np.ndarray:
    bitmap, bits = np.zeros(1 << 17, np.uint8), 1 << 20
    for shift in (0, 20):
        at = (table >> np.uint64(shift)) & np.uint64(bits - 1)
        np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bitmap


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of labelled rows (id, toxic); None if a label has no row."""
    known = labels.where("toxic is not null").groupBy(id_col).agg(F.max("toxic").alias("toxic")).where(F.col(id_col).isNotNull())
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col(id_col).alias("_id"), F.col("toxic").cast("long"))
    # at most 2 * sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").select("text", "toxic")
    counts = rows.mapInArrow(_count, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n = rows.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in n}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return None
    t, c = F.col("t"), F.col("c")
    pooled = (t + c) / F.lit(n1 + n0)
    spread = F.sqrt(pooled * (1 - pooled) * F.lit(1 / n1 + 1 / n0)) + F.lit(1e-12)
    z = (t / F.lit(n1) - c / F.lit(n0)) / spread
    odds = F.log((t + 0.5) / (F.lit(n1) - t + 0.5)) - F.log((c + 0.5) / (F.lit(n0) - c + 0.5))
    chosen = counts.where((t >= SEEN) & (z >= DEVIATIONS) & (odds >= ODDS)).orderBy(z.desc(), "f").limit(LEXICON).collect()
    if not chosen:
        return Model(np.zeros(1, np.uint64), np.zeros(1 << 17, np.uint8), np.zeros(1), (-4.0, -1.0, 0.0, 0.0), np.array([np.log(n1 / n0), 0, 0, 0]))
    chosen.sort(key=lambda r: r.f % (1 << 64))
    table = np.array([r.f % (1 << 64) for r in chosen], np.uint64)
    strong = np.array([(r.t / n1) / (r.t / n1 + r.c / n0) >= STRONG for r in chosen])
    bitmap = make_filter(table)
    found = rows.mapInArrow(_sparse(table, bitmap), "toxic long, n long, place array<int>, f array<int>").toArrow()
    label, n_words = found.column("toxic").to_numpy(), found.column("n").to_numpy()
    place, ids = found.column("place").combine_chunks(), found.column("f").combine_chunks()
    cut = np.concatenate([[0], np.cumsum(place.value_lengths().to_numpy())])
    flat, ids = place.flatten().to_numpy().astype(np.int64), ids.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), np.diff(cut))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    of = np.cumsum(new) - 1
    hits = Hits(row[new], flat[new], n_words, ids, of)
    tags = (np.bincount(of, strong[ids], len(hits.row)) > 0) & (label[hits.row] == 1)
    weights, four = _fit_chain(hits, tags, len(table))
    log_z, marginal = Chain(*four).run(hits, np.bincount(of, weights[ids], len(hits.row)))
    return Model(table, bitmap, weights, tuple(four), _fit_score(summary(hits, log_z, marginal), label.astype(float)))


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
OUT = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("spans", SPAN)])
OUT_SQL = "id long, score double, spans array<struct<start:int,end:int,p:double>>"


def _score(model: Model):
    def run(batches):
        for rb, data, off in slices(batches):
            starts, ends, tok, kinds = features(data, off)
            score, hits, words, marginal = model.apply(tok, kinds)
            spans: list[list] = [[] for _ in range(rb.num_rows)]
            strong = np.flatnonzero(marginal >= 0.5)
            if len(strong):
                # offsets count code points: bytes that do not continue one
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for k in strong.tolist():
                    r, w = hits.row[k], words[k]
                    spans[r].append({"start": points[starts[w]] - points[off[r]], "end": points[ends[w]] - points[off[r]], "p": marginal[k]})
            yield out_batch(OUT, rb.column("id"), score, pa.array(spans, SPAN))

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score and spans (code points from, to, marginal) of offending words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int,p:double>>").alias("spans"))
    return rows.mapInArrow(_score(model), OUT_SQL)


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs as they are with one more column, the score."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    names = [*docs.columns, name]

    def run(batches):
        for rb, data, off in slices(batches, text_col):
            _, _, tok, kinds = features(data, off)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(model.apply(tok, kinds)[0])], names=names)

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    out = score(docs, fit(docs, labels.select("doc_id", "toxic")))
    held = F.coalesce(fold("id", 5) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
