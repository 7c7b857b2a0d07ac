"""Quality by a linear-chain conditional random field over lines.

Lines are what newlines part, if they hold a word. A line's own features are shares of its bytes and words (letters,
capitals, digits, full stops, other signs, words that end in a sign, repeated words, doubled words, lines seen before in
the document) and lengths; its neighbours' features stand beside them. Two states, good and bad; a line's weight in each
place is linear in the features, transitions are free.

The chain is fitted to a bounded sample of labelled documents (SAMPLE of each label, of each at most LINES neighbouring
lines from a place drawn by hash). Lines take their documents' labels; a model of single lines by their own features then
tags those lines of bad documents good that look so (a shared passage, a footer), all but the worst line. The chain is
fitted to these tags. Gradients are of the conditional likelihood, from marginals of lines and of pairs of neighbours.

Forward and backward messages are products of 2 x 2 matrices over the lines of a document. They are made by doubling, for
all documents of a slice at once, so a document of a million lines takes twenty passes and no loop over lines.

A document's score is a logistic function, fitted on the same sample with the weights of all labelled documents, of the
mean of its lines' probabilities of bad, weighted by length, and of that mean's log odds.

Defined results: null or empty text, or no line with a word: the share of good documents among the labelled ones; no
labelled rows of either label: score 0 for all; several labels for an id: the highest; null labels: ignored; text of any
length: scored whole; null id: scored; rows that share an id: scored each by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import find_words, out_batch, rows_of, slices, small_batches, word_hashes
from tabulora.llm.toxicity import fold

#: Sample documents of each label, most lines of each.
SAMPLE, LINES = 2048, 128
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
#: Own features of a line.
N = 13

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _kinds() -> np.ndarray:
    """For each byte 0: space, 1: letter, 2: capital, 3: digit, 4: sign of a sentence, 5: other sign, 6: inside a code point."""
    out = np.full(256, 5, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[97:123] = 1
    out[65:91] = 2
    out[48:58] = 3
    for c in b".,;:?'\"()-":
        out[c] = 4
    out[0x80:0xC0] = 6
    out[0xC0:] = 1
    return out


KINDS = _kinds()


def _seen_before(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a key has occurred before in its group."""
    order = np.lexsort((np.arange(len(key)), key, group))
    k, g = key[order], group[order]
    again = np.zeros(len(key), bool)
    again[1:] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    out = np.empty(len(key), bool)
    out[order] = again
    return out


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (a row for each line with a word), lengths in code points, and the first line of each row of text."""
    starts, ends, _ = find_words(data, off, NEWLINE)
    kinds = KINDS[data]
    # lines of spaces only do not count
    some = np.concatenate([[0], np.cumsum(kinds > 0)])
    full = some[ends] > some[starts]
    starts, ends = starts[full], ends[full]
    first = np.searchsorted(starts, off)
    n = len(starts)

    def count(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    size = np.maximum(count(kinds != 6), 1)
    w_start, w_end, w_first = find_words(data, off)
    of = np.searchsorted(starts, w_start, "right") - 1
    ok = of >= 0
    w_start, w_end, of = w_start[ok], w_end[ok], of[ok]
    words = np.maximum(np.bincount(of, minlength=n).astype(np.float64), 1)
    h = word_hashes(data, w_start, w_end)
    again = np.bincount(of, _seen_before(h, of), n) / words
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    tail = kinds[np.maximum(w_end - 1, 0)]
    row = np.searchsorted(off, starts, "right") - 1
    x = np.stack([
        count((kinds == 1) | (kinds == 2)) / size,
        count(kinds == 2) / size,
        count(kinds == 3) / size,
        count(kinds == 4) / size,
        count(kinds == 5) / size,
        np.bincount(of, tail == 5, n) / words,
        np.bincount(of, (w_end - w_start == 1) & (tail >= 4), n) / words,
        again,
        np.bincount(of, twice, n) / words,
        _seen_before(word_hashes(data, starts, ends), row).astype(np.float64),
        np.log1p(words),
        np.log1p(size / words),
        np.log1p(np.maximum.reduceat(np.append(w_end - w_start, 0), np.searchsorted(of, np.arange(n))) if n else np.zeros(0)),
    ], axis=1)
    return x, size, first


def beside(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, a line's own (scaled) features, those of the line before and of the one after (0 outside the document)."""
    n = len(x)
    head = np.zeros(n, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    last = np.append(head[1:], True)[:n]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[head], after[last] = 0, 0
    return np.concatenate([np.ones((n, 1)), x, before, after], axis=1)


# ---------------------------------------------------------------- chain
def _products(m: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each matrix the product from its document's first one (index start) to it, each divided by its largest cell."""
    out, step, at = m.copy(), 1, np.arange(len(m))
    while True:
        some = np.flatnonzero(at - step >= start)
        if not len(some):
            return out
        made = out[some - step] @ out[some]
        out[some] = made / made.max(axis=(1, 2), keepdims=True)
        step *= 2


def marginals(bad: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line, and the expected number of each pair of neighbouring states. bad: a line's weight of bad against
    good; move: weights of the transitions."""
    n = len(bad)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    count = np.diff(first)
    start, end = np.repeat(first[:-1], count), np.repeat(first[1:], count) - 1
    half = np.clip(bad, -30, 30) / 2
    emit = np.exp(np.stack([-half, half], axis=1))
    m = np.exp(move)[None] * emit[:, None, :]
    m[start] = emit[start][:, None, :]  # a document's first line follows nothing
    m /= m.max(axis=(1, 2), keepdims=True)
    forward = _products(m, start)[:, 0]
    # backward: products from the next line to the last, made as forward ones of the transposed, reversed chain
    back = np.empty_like(m)
    back[:-1] = m[1:]
    back[end] = np.eye(2)
    flipped = _products(back.transpose(0, 2, 1)[::-1], (n - 1 - end)[::-1])[::-1]
    backward = flipped.sum(axis=1)
    both = forward * backward
    p = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(np.arange(n) > start)
    pair = forward[inner - 1][:, :, None] * m[inner] * backward[inner][:, None, :]
    return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit_chain(x: np.ndarray, tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the transitions, by Adam on the penalised conditional likelihood."""
    n = len(x)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    gold = np.zeros((2, 2))
    np.add.at(gold, (tags[at - 1], tags[at]), 1)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, STEPS + 1):
        p, pairs = marginals(x @ w, move, first)
        slope = np.concatenate([x.T @ (tags - p), (gold - pairs).ravel()]) / n - RIDGE * np.concatenate([w, move.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        go = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, move = w + go[: len(w)], move + go[len(w) :].reshape(2, 2)
    return w, move


def summary(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, the mean of P(bad) weighted by length, and its log odds; a row for each document (0.5 for one without lines)."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(row, size, n)
    share = np.where(total > 0, np.bincount(row, size * p, n) / np.maximum(total, 1), 0.5)
    odds = np.log((share + 1e-3) / (1 - share + 1e-3))
    return np.stack([np.ones(n), share, odds], axis=1)


class Model:
    """What scores texts: scale of the features, weights of the chain, weights of the summary, and the share of good."""

    def __init__(self, mean, scale, weights, move, score, prior):
        self.mean, self.scale, self.weights, self.move, self.score, self.prior = mean, scale, weights, move, score, prior

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(beside(self.scaled(x), first) @ self.weights, self.move, first)[0]

    def apply(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each row, P(bad) of each line, and the first line of each row."""
        x, size, first = line_features(data, off)
        p = self.lines(x, first)
        good = 1 / (1 + np.exp(-np.clip(summary(p, size, first) @ self.score, -30, 30)))
        return np.where(np.diff(first) > 0, good, self.prior), p, first


def _fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
    return b


ROWS = pa.schema([("quality", pa.int64()), ("size", pa.list_(pa.float64())), ("x", pa.list_(pa.float64()))])


def _lines(most: int):
    """Of each sample document the features of at most so many neighbouring lines."""

    def run(batches):
        for rb, data, off in slices(batches):
            x, size, first = line_features(data, off)
            for i, (y, draw) in enumerate(zip(rb.column("quality").to_pylist(), rb.column("draw").to_pylist(), strict=True)):
                a, b = int(first[i]), int(first[i + 1])
                if b - a > most:
                    a += draw % (b - a - most + 1)
                    b = a + most
                yield out_batch(ROWS, [y], [size[a:b]], [x[a:b].ravel()])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, lines: int = LINES) -> Model | None:
    """The model of a bounded sample of labelled rows (id, quality); None if a label has no row."""
    known = labels.where("quality is not null").groupBy(id_col).agg(F.max("quality").alias("quality")).where(F.col(id_col).isNotNull())
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().where("quality in (0, 1)").collect()}
    if set(counts) != {0, 1}:
        return None
    # the id without anything beside it and a number to draw lines by: at most 2 * sample rows of three numbers
    picked = [known.where(F.col("quality") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col(id_col).alias("_id"), F.col("quality").cast("long"), F.pmod(F.xxhash64(F.lit("lines"), id_col), F.lit(1 << 31)).alias("draw"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").select("text", "quality", "draw")
    found = rows.mapInArrow(_lines(lines), "quality long, size array<double>, x array<double>")
    # repeated ids in docs could make more rows than were picked
    found = found.orderBy(F.xxhash64("x", "size"), "quality").limit(2 * sample).toArrow()
    y = found.column("quality").to_numpy()
    if not (y == 0).any() or not (y == 1).any():
        return None
    size, x = (found.column(c).combine_chunks() for c in ("size", "x"))
    first = np.concatenate([[0], np.cumsum(size.value_lengths().to_numpy())]).astype(np.int64)
    size, x = size.flatten().to_numpy(), x.flatten().to_numpy().reshape(-1, N)
    weight = np.array([counts[v] / max(1, (y == v).sum()) for v in (0, 1)])[y]
    prior = counts[1] / (counts[0] + counts[1])
    if not len(x):
        return Model(np.zeros(N), np.ones(N), np.zeros(3 * N + 1), np.zeros((2, 2)), np.zeros(3), prior)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, None, None, None, prior)
    wide, row = beside(model.scaled(x), first), np.repeat(np.arange(len(y)), np.diff(first))
    tags = 1 - y[row]
    # each line alone, by its own features; of a bad document at least the worst line stays bad
    alone = wide[:, : N + 1]
    odds = alone @ fit_chain(alone, tags, np.arange(len(x) + 1))[0]
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, row, odds)
    tags = np.where((tags == 1) & (odds < 0) & (odds < worst[row]), 0, tags)
    model.weights, model.move = fit_chain(wide, tags, first)
    p = marginals(wide @ model.weights, model.move, first)[0]
    model.score = _fit_score(summary(p, size, first), y.astype(float), weight * len(y) / weight.sum())
    return model


LINE = pa.list_(pa.float64())
OUT = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("lines", LINE)])


def _score(model: Model):
    def run(batches):
        for rb, data, off in slices(batches):
            score, p, first = model.apply(data, off)
            lines = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(p))
            yield out_batch(OUT, rb.column("id"), score, lines)

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score (of good) and lines: for each line with a word, in order, the probability that it is bad."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("lines"))
    return rows.mapInArrow(_score(model), "id long, score double, lines array<double>")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    out = score(docs, fit(docs, labels.select("doc_id", "quality")))
    held = F.coalesce(fold("id", 3) == 1, F.lit(False))
    n_bad = F.size(F.filter("lines", lambda p: p >= 0.5))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("lines").alias("n_lines"), n_bad.alias("n_bad_lines"))
