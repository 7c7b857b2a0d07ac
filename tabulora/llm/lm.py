"""Language-model scores by deleted interpolation.

A word's probability after its predecessor mixes the maximum-likelihood bigram estimate with an add-one unigram:
P(w | v) = a * c(v w) / c(v) + (1 - a) * (c(w) + 1) / (N + V + 1). With order 3, the estimate after two words is mixed
with that: P(w | u v) = b * c(u v w) / c(u v) + (1 - b) * P(w | v). The weight a depends on the bucket (power of two) of
c(v), b on that of c(u v). A part of the training documents is held out at first; the weights are found by
expectation-maximisation on its bigram (then its trigram) counts under the counts of the rest. Then all training counts
serve.

Texts become blocks of a few megabytes: the distinct words' hashes and, for each token, the number of its word. From
then on only the blocks' distinct keys travel: each block sends its distinct words (later its distinct bigrams and trigrams), dealt
by ranges of the hash and packed, with its own counts; the task of a range adds up and sends each block the totals of
its keys. So a word or bigram that is in every document is one entry for each block, nothing is sent for single tokens,
and what a task holds is the keys of one range: their number falls with the number of shuffle partitions.

Tokens are the words with A-Z lower-cased and one end for each document; a text's first word follows the end alone. Defined
results: null or empty text: the end alone; no training documents: each token has probability 1 / (N + V + 1) with N =
V = 0; equal rows: scored and counted each; null id: a training document (its remainder is not 2) outside the held part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import LOWER, STEP, Work, as_long, find_words, mix, out_batch, partitions, slices, word_hashes
from tabulora.llm.toxicity import fold

#: Bytes of text of a block; documents that are held out for the weights: one in HELD of the training ones.
BLOCK, HELD = 3 << 20, 40
END = np.uint64(0x9D5C0F2B7A31E685)
#: What a document is for: to be scored only, counted, or held out for the weights and counted at last.
TEST, MAIN, PART = 0, 1, 2


# ---------------------------------------------------------------- packing
def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as planes of bytes, compressed; planes of zeros cost next to nothing."""
    b = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
    top = 8
    while top > 1 and not b[:, top - 1].any():
        top -= 1
    return bytes([top]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(b[:, :top].T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    top = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(top, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :top] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(raw))


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n ranges of hashes in sorted keys."""
    cuts = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


# ---------------------------------------------------------------- blocks
#: kind 0: a block; 1: counts of words; 2: counts of bigrams; 3: counts of trigrams. p is the range.
ROW = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("id", pa.list_(pa.int64())), ("part", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
ROW_SQL = "p int, block long, kind int, a binary, b binary, c binary, d binary, id array<bigint>, part array<int>, n array<bigint>"


def _blocks(batches):
    """A block: hashes of its words, the commonest first; the number of each token's word; ids, parts, token counts."""
    hashes, ids, parts, counts, size = [], [], [], [], 0

    def flush():
        h = np.concatenate(hashes)
        words, code, n = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        with np.errstate(over="ignore"):
            name = mix(np.array([mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(STEP)).sum() + np.uint64(hash((tuple(ids), tuple(counts))) % (1 << 63))], np.uint64))
        return out_batch(ROW, [0], as_long(name), [0], [words[order].tobytes()], [pack(rank[code.ravel()])], [None], [None], [list(ids)], [list(parts)], [list(counts)])

    for rb, data, off in slices(batches):
        data = LOWER[data]
        starts, ends, tok = find_words(data, off)
        own = np.diff(tok) + 1
        h = np.full(int(own.sum()), END, np.uint64)
        at = np.ones(len(h), bool)
        at[np.cumsum(own) - 1] = False
        h[at] = word_hashes(data, starts, ends)
        hashes.append(h)
        ids += rb.column("id").to_pylist()
        parts += rb.column("part").to_pylist()
        counts += own.tolist()
        size += len(data) + len(own)
        if size > BLOCK:
            yield flush()
            hashes, ids, parts, counts, size = [], [], [], [], 0
    if hashes:
        yield flush()


class Block:
    def __init__(self, row: dict):
        self.name, self.ids, self.parts, self.n = row["block"], row["id"], np.array(row["part"], np.int8), np.array(row["n"], np.int64)
        self.words = np.frombuffer(row["a"], np.uint64)
        self.codes = unpack(row["b"]).astype(np.int32)
        self.part = np.repeat(self.parts, self.n)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def word_order(self) -> np.ndarray:
        return np.argsort(self.words)

    def bigrams(self):
        """Keys of the distinct bigrams, ascending; for each token the number of its bigram; both words of each."""
        end = int(np.flatnonzero(self.words == END)[0])
        before = np.empty(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[self.first[:-1]] = end
        before *= len(self.words)
        before += self.codes
        pairs, of = np.unique(before, return_inverse=True)
        del before
        of = of.ravel().astype(np.int32)
        v, w = (pairs // len(self.words)).astype(np.int32), (pairs % len(self.words)).astype(np.int32)
        del pairs
        with np.errstate(over="ignore"):
            key = mix(self.words[v] * np.uint64(STEP) + self.words[w])
        order = np.argsort(key)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return key[order], place[of], v[order], w[order]

    def trigrams(self, pair_keys, pair_of):
        """Keys of the distinct trigrams, ascending; the tokens with two before them in their text (its end counts) and
        the number of the trigram of each; the number of the bigram and the last word of each trigram."""
        follows = np.ones(len(self.codes), bool)
        follows[self.first[:-1]] = False
        at = np.flatnonzero(follows).astype(np.int32)
        triples = pair_of[at - 1].astype(np.int64)
        triples *= len(self.words)
        triples += self.codes[at]
        triples, of = np.unique(triples, return_inverse=True)
        of = of.ravel().astype(np.int32)
        c, x = (triples // len(self.words)).astype(np.int32), (triples % len(self.words)).astype(np.int32)
        del triples
        with np.errstate(over="ignore"):
            key = mix(pair_keys[c] * np.uint64(STEP) + self.words[x])
        order = np.argsort(key)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return key[order], at, place[of], c[order], x[order]


def _requests(kind, n_parts):
    """A block's distinct keys by range, with the counts of its main and its held part; for held bigrams and trigrams
    their words."""

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                b, rows = Block(row), []
                role = b.part
                if kind == 1:
                    order = b.word_order()
                    keys, of = b.words[order], np.empty(len(order), np.int64)
                    of[order] = np.arange(len(order))
                    of = of[b.codes]
                else:
                    keys, of, *names = b.bigrams()
                if kind == 3:
                    keys, at, of, c, x = b.trigrams(keys, of)
                    role = role[at]
                    del at
                main = np.bincount(of[role == MAIN], minlength=len(keys)).astype(np.uint64)
                part = np.bincount(of[role == PART], minlength=len(keys)).astype(np.uint64)
                del of
                cut = ranges(keys, n_parts)
                for p, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if j > i:
                        pairs = None
                        if kind > 1:
                            at = i + np.flatnonzero(part[i:j])
                            own = (names[0][at], names[1][at]) if kind == 2 else (names[0][c[at]], names[1][c[at]], x[at])
                            pairs = np.concatenate([b.words[k] for k in own]).tobytes()
                        rows.append((p, b.name, kind, pack_sorted(keys[i:j]), pack(main[i:j]), pack(part[i:j]), pairs, None, None, None))
                if rows:
                    yield out_batch(ROW, *zip(*rows, strict=True))

    return run


#: An answer is a row of ROW (a: main counts, b: held counts); a word, a held bigram or a held trigram is a row with v.
ANSWER = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("main", pa.int64()), ("held", pa.int64())])
ANSWER_SQL = "p int, block long, kind int, a binary, b binary, u long, v long, w long, main long, held long"


def _answers(kind):
    """Adds up the counts of one range and answers each block."""

    def run(batches):
        rows = [r for rb in batches for r in rb.select(["p", "block", "a", "b", "c", "d"]).to_pylist()]
        by: dict = {}
        for r in rows:
            by.setdefault(r["p"], []).append(r)
        del rows
        for p, of_p in by.items():
            keys = [unpack_sorted(r.pop("a")) for r in of_p]
            sizes = [len(k) for k in keys]
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            mains, helds = [unpack(r.pop("b")) for r in of_p], [unpack(r.pop("c")) for r in of_p]
            main = np.bincount(of, np.concatenate(mains), len(distinct)).astype(np.int64)
            held = np.bincount(of, np.concatenate(helds), len(distinct)).astype(np.int64)
            of, at, pairs, counts = of.ravel(), 0, [], []
            for r, n, own in zip(of_p, sizes, helds, strict=True):
                mine = of[at : at + n]
                at += n
                yield out_batch(ANSWER, [p], [r["block"]], [kind], [pack(main[mine].astype(np.uint64))], [pack(held[mine].astype(np.uint64))], [None], [None], [None], [None], [None])
                if kind > 1:
                    some = np.flatnonzero(own)
                    pairs.append(np.frombuffer(r["d"], np.uint64).reshape(kind, -1))
                    counts.append((main[mine[some]], own[some].astype(np.int64)))
            if kind == 1:
                some = np.flatnonzero(main + held)
                v, w, main, held = distinct[some], np.zeros(len(some), np.uint64), main[some], held[some]
                u = w
            else:
                *first, v, w = np.concatenate(pairs, axis=1)
                u = first[0] if first else np.zeros(len(v), np.uint64)
                main, held = (np.concatenate(x) for x in zip(*counts, strict=True))
            for i in range(0, len(v), 50_000):
                s = slice(i, i + 50_000)
                n = len(v[s])
                yield out_batch(ANSWER, [p] * n, pa.nulls(n, pa.int64()), [kind] * n, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), as_long(u[s]), as_long(v[s]), as_long(w[s]), main[s], held[s])

    return run


def _exchange(work: Work, blocks: DataFrame, kind: int) -> DataFrame:
    n = partitions(work.spark)
    asked = blocks.mapInArrow(_requests(kind, n), ROW_SQL).repartitionById(n, F.col("p"))
    out = work.write(asked.mapInArrow(_answers(kind), ANSWER_SQL), f"answers{kind}", compression="zstd")
    return out


# ---------------------------------------------------------------- weights
def _sides(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the word before and of the word itself. They lie in files beside packed answers, so Spark takes their rows
    for far fewer than they are and would broadcast the vocabulary: a merge join is asked for, as for held trigrams."""
    return words.select("v", F.col("main").alias("cv")).hint("merge"), words.select(F.col("v").alias("w"), F.col("main").alias("cw")).hint("merge")


def find_weights(held: DataFrame, words: DataFrame) -> dict[int, float]:
    """Weight of the bigram estimate for each bucket of context counts, by expectation-maximisation.

    held: (v, w, main, held) counts of the bigrams of the held part; words: (v, main). What the weights depend on is, for
    each bucket, how often the held part has which ratio of the two estimates, so a histogram of the ratio (8 steps to a
    power of two) is gathered, of a size that does not depend on the data.
    """
    total = words.agg(F.coalesce(F.sum("main"), F.lit(0)).alias("n"), F.count(F.when(F.col("main") > 0, 1)).alias("v")).first()
    if not total.n:
        return {}
    left, right = _sides(words)
    both = held.join(left, "v").where("cv > 0").join(right, "w", "left")
    ratio = (F.col("main") / F.col("cv")) / ((F.coalesce("cw", F.lit(0)) + 1) / F.lit(total.n + total.v + 1))
    step = F.when(F.col("main") > 0, F.floor(8 * F.log2(ratio)))
    return _maximise(both.groupBy(_bucket(F.col("cv")).alias("bucket"), step.alias("step")).agg(F.sum("held").alias("n")).collect())


def _maximise(rows) -> dict[int, float]:
    """Weights by bucket from rows (bucket, step, n)."""
    out: dict[int, float] = {}
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        n = np.array([r.n for r in own], float)
        x = np.array([0.0 if r.step is None else 2 ** ((r.step + 0.5) / 8) for r in own])
        a = 0.5
        for _ in range(200):
            a = float((n * a * x / (a * x + 1 - a)).sum() / n.sum())
            a = min(max(a, 1e-4), 1 - 1e-4)
        out[int(bucket)] = a
    return out


def find_trigram_weights(held: DataFrame, pairs: DataFrame, words: DataFrame, weights: dict[int, float]) -> dict[int, float]:
    """Weight of the trigram estimate for each bucket of counts of the two words before, in the same way.

    held: (u, v, w, main, held); pairs and words: as find_weights has them, which gave the weights. The two bigrams of a
    held trigram are held ones of the same text, so pairs has both.
    """
    total = words.agg(F.coalesce(F.sum("main"), F.lit(0)).alias("n"), F.count(F.when(F.col("main") > 0, 1)).alias("v")).first()
    if not total.n or not weights:
        return {}
    left, right = _sides(words)
    both = pairs.groupBy("v", "w").agg(F.max("main").alias("main")).join(left, "v").join(right, "w", "left")
    one = (F.coalesce("cw", F.lit(0)) + 1) / F.lit(total.n + total.v + 1)
    a = F.get(F.array(*[F.lit(float(x)) for x in _table(weights)]), _bucket(F.col("cv")))
    lower = F.when(F.col("cv") > 0, a * F.col("main") / F.col("cv") + (1 - a) * one).otherwise(one)
    both = both.select("v", "w", F.col("main").alias("cvw"), lower.alias("lower"))
    before = both.where("cvw > 0").select(F.col("v").alias("u"), F.col("w").alias("v"), F.col("cvw").alias("cuv"))
    every = held.join(before.hint("merge"), ["u", "v"]).join(both.select("v", "w", "lower").hint("merge"), ["v", "w"])
    step = F.when(F.col("main") > 0, F.floor(8 * F.log2(F.col("main") / F.col("cuv") / F.col("lower"))))
    return _maximise(every.groupBy(_bucket(F.col("cuv")).alias("bucket"), step.alias("step")).agg(F.sum("held").alias("n")).collect())


def _table(weights: dict[int, float]) -> np.ndarray:
    """Weights of all buckets: of one without its own, the nearest one's."""
    return np.array([weights.get(k, weights[min(weights, key=lambda j: abs(j - k))]) if weights else 0.0 for k in range(64)])


def _bucket(count):
    return F.floor(F.log2(count)).cast("int")


# ---------------------------------------------------------------- scores
OUT = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUT_SQL = "id long, part int, n_tokens long, n_known long, base_score double, score double"


def _scores(n_tokens, n_words, weights, weights3, order_of):
    """Of rows sorted by block, kind and range: the block, totals of its words, of its bigrams, of its trigrams."""
    table, table3 = _table(weights), _table(weights3)

    def run(batches):
        def finish(blocks, words, pairs, triples):
            joined = []
            for t in (words, pairs, triples):
                joined.append(np.concatenate([t[p] for p in sorted(t)]) if t else None)
                t.clear()
            for b in blocks:
                order = b.word_order()
                c = np.empty(len(order))
                c[order] = joined[0]
                keys, of, v, _ = b.bigrams()
                one = (c + 1) / (n_tokens + n_words + 1)
                context = c[v]
                a = np.where(context > 0, table[np.log2(np.maximum(context, 1)).astype(np.int64)], 0.0)
                add = lambda x: np.add.reduceat(x, b.first[:-1])
                known = add((c[b.codes] > 0).astype(np.int64))
                p = one[b.codes]
                base = add(np.log10(p))
                p *= (1 - a)[of]
                p += (a * joined[1] / np.maximum(context, 1))[of]
                del a, context, v
                if order_of > 2 and joined[2] is not None:
                    _, at, of, pair, _ = b.trigrams(keys, of)
                    del keys
                    context = joined[1][pair].astype(float)
                    a = np.where(context > 0, table3[np.log2(np.maximum(context, 1)).astype(np.int64)], 0.0)
                    lower = p[at]
                    lower *= (1 - a)[of]
                    a *= joined[2] / np.maximum(context, 1)
                    lower += a[of]
                    p[at] = lower
                yield out_batch(OUT, b.ids, b.parts, b.n, known, base, add(np.log10(p)))

        name, blocks, totals = None, [], ({}, {}, {})
        for rb in batches:
            for row in rb.to_pylist():
                if row["block"] != name:
                    yield from finish(blocks, *totals)
                    name, blocks, totals = row["block"], [], ({}, {}, {})
                if row["kind"] == 0:
                    blocks.append(Block(row))
                else:
                    totals[row["kind"] - 1][row["p"]] = unpack(row["a"]) + unpack(row["b"])
        yield from finish(blocks, *totals)

    return run


def interpolated_scores(docs: DataFrame, training, held=None, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Per row of docs: id, training, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    training: a boolean column of docs; held: which of these are held out for the weights (by default one in HELD);
    order: 2 or 3, the words of the longest counted runs.
    """
    work = Work(docs.sparkSession, "lm")
    if held is None:
        held = F.pmod(F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 7), F.lit(HELD)) == 0
    yes = F.lit(False)
    part = F.when(F.coalesce(training, yes), F.when(F.coalesce(held, yes), PART).otherwise(MAIN)).otherwise(TEST).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), part.alias("part"))
    blocks = work.write(rows.mapInArrow(_blocks, ROW_SQL), "blocks")
    words = _exchange(work, blocks, 1)
    pairs = _exchange(work, blocks, 2)
    tables = [words, pairs, _exchange(work, blocks, 3)] if order > 2 else [words, pairs]
    each = words.where("v is not null")
    total = each.agg(F.coalesce(F.sum(F.col("main") + F.col("held")), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    held_pairs = pairs.where("v is not null").select("v", "w", "main", "held")
    with work.cleaned():
        weights, weights3 = find_weights(held_pairs, each.select("v", "main")), {}
        if order > 2:
            weights3 = find_trigram_weights(tables[2].where("v is not null").select("u", "v", "w", "main", "held"), held_pairs, each.select("v", "main"), weights)
    every = blocks
    for x in tables:
        every = every.unionByName(x.where("v is null").select("p", "block", "kind", "a", "b"), allowMissingColumns=True)
    dealt = every.repartition(partitions(work.spark), "block").sortWithinPartitions("block", "kind", "p")
    out = work.write(dealt.mapInArrow(_scores(total.n, total.v, weights, weights3, order), OUT_SQL), "scores")
    work.only("scores")
    return out.select("id", (F.col("part") != TEST).alias("training"), "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = interpolated_scores(docs, F.coalesce(fold("doc_id", 7) != 2, F.lit(True)), order=3)
    return out.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
