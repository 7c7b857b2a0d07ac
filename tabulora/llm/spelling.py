"""Spelling variants by generation of the full neighbourhood of each word.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. They are counted with numpy over whole
slices of text, so a slice gives one row for each of its words and a word that a third of all documents hold is a small
row for each task. The vocabulary is what is long and frequent enough.

For each word of the vocabulary all distinct deletions, replacements and insertions over the letters that the vocabulary
has are generated, as 64-bit hashes that follow from the word's own prefix sums. A bitmap of the vocabulary of bounded
size (common.key_filter) keeps candidates that cannot be words from being written out; the others are joined to the
vocabulary by their letters. A candidate is one edit away by its making, so the join's rows are the neighbours: nothing
is compared or verified afterwards. Neighbours are directed by frequency, and roots found by doubling of pointers: a form
is at least FACTOR times as frequent as its word, so chains are short.

All letters lie below U+0100, so inside this module a word is a row of bytes, one for each letter.

Defined results: null or empty text: no words; null id: its runs count as they are, no letter is taken out; repeated rows
count as often as they stand; a text of any length is taken whole; empty table or vocabulary: no rows; further columns
are not looked at; ties of frequency: the first in code-point order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import BACK, BYTE_VALUES, LOWER, STEP, Work, as_long, in_filter, key_filter, longs, mix, out_batch, slices, text_of

#: Least letters and occurrences of a word, and how many times as frequent as its word a form is.
LETTERS, SEEN, FACTOR = 5, 3, 2
#: One of so many runs (by crc32) loses a letter.
TYPOS = 97
#: Bytes of a run that are hashed along with all others; longer ones are hashed alone.
SHORT = 64
#: Cells of the matrices of one step of generation.
CELLS = 1 << 20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()


def _crcs(data, starts, ends, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, carried on from the one of its row."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    sizes, s, c = size[order], starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-sizes, -SHORT, "left"))
    for j in range(min(SHORT, int(sizes[long])) if long < len(sizes) else 0):
        live = slice(long, int(np.searchsorted(-sizes, -j, "left")))
        c[live] = CRC[(c[live] ^ data[s[live] + j]) & np.uint32(0xFF)] ^ (c[live] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[s[i] : s[i] + sizes[i]].tobytes(), int(before[order[i]]))
    out = np.empty_like(c)
    out[order] = c
    return out


def runs(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters, and the row of each."""
    n = len(low)
    lead = low == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
    inside = lead | ((low >= 97) & (low <= 122))
    inside[1:] |= lead[:-1]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(off, starts, "right") - 1


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(letters: int, typos: int):
    def run(batches):
        for rb, data, off in slices(batches):
            low = LOWER[data]
            starts, ends, row = runs(low, off)
            if not len(starts):
                continue
            new = (low & 0xC0) != 0x80
            points = np.concatenate([[0], np.cumsum(new)])
            size = points[ends] - points[starts]
            gone = np.zeros(len(low), bool)
            if typos:
                ids, ok = longs(rb.column("id"))
                before = np.array([zlib.crc32(b"%d:" % i) for i in ids.tolist()], np.uint32)
                h = _crcs(low, starts, ends, before[row])
                hit = np.flatnonzero((h % typos == 0) & ok[row])
                at = np.flatnonzero(new)[points[starts[hit]] + h[hit] % size[hit]]
                gone[at] = True
                gone[at[low[at] == 0xC3] + 1] = True
                size[hit] -= 1
            some = size >= letters
            edge = np.zeros(len(low) + 1, np.int8)
            edge[starts[some]] += 1
            edge[ends[some]] -= 1
            kept = (np.cumsum(edge[:-1]) > 0) & ~gone
            total = np.concatenate([[0], np.cumsum(kept)])
            cut = np.append(total[starts[some]], total[-1]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(low[kept].tobytes()))
            found = words.value_counts()
            yield out_batch(COUNTS, found.field("values"), found.field("counts"))

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, seen: int = SEEN, typos: int = 0) -> DataFrame:
    """word, n: the runs of at least so many letters that occur at least so often. typos: every run of a document whose
    crc32, of `<id>:<run>`, that number divides loses the letter at crc32 modulo its length first; 0: none does."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(letters, typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


# ---------------------------------------------------------------- neighbourhood
def _letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each letter of a column of words, and where each word begins."""
    data, off = text_of(col)
    kept = data != 0xC3
    at = np.concatenate([[0], np.cumsum(kept)])[off]
    return np.where(data >= 0x80, data + np.uint8(0x40), data)[kept], at


def _groups(data: np.ndarray, off: np.ndarray):
    """Words of equal length, as many as CELLS allows: their indices and letters as a matrix."""
    size = np.diff(off)
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(part) and (n := int(size[part[0]])):
            step = max(1, CELLS // (256 + n))
            for i in range(0, len(part), step):
                yield part[i : i + step], data[off[part[i : i + step]][:, None] + np.arange(n)]


def _sums(words: np.ndarray):
    """Values of letters, powers by place, and sums over the letters before each place."""
    n = words.shape[1]
    power = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(n, STEP, np.uint64))
        value = BYTE_VALUES[words]
        sums = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(value * power[:n], axis=1, out=sums[:, 1:])
    return value, power, sums


HASHES = pa.schema([("h", pa.int64())])
LETTER = pa.schema([("c", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("near", pa.string())])


def _hash(batches):
    for rb in batches:
        for _, words in _groups(*_letters(rb.column("word"))):
            yield out_batch(HASHES, as_long(mix(_sums(words)[2][:, -1])))


def _alphabet(batches):
    seen = np.zeros(256, bool)
    for rb in batches:
        seen[_letters(rb.column("word"))[0]] = True
    yield out_batch(LETTER, np.flatnonzero(seen))


def edits(words: np.ndarray, alphabet: np.ndarray, wanted):
    """All distinct results of one edit whose hashes are wanted: index of the word and the letters, for each place.

    A letter is taken out of a run of equal ones only at the run's end, and put in only where the next letter differs, so
    no result of a word comes twice.
    """
    n = words.shape[1]
    value, power, sums = _sums(words)
    whole, letter = sums[:, -1:], BYTE_VALUES[alphabet]
    with np.errstate(over="ignore"):
        for j in range(n + 1):
            rest, put = whole - sums[:, j : j + 1], letter * power[j]
            other = words[:, j : j + 1] != alphabet if j < n else np.ones((len(words), len(alphabet)), bool)
            for shift, hashes, valid in (
                (0, sums[:, j : j + 1] + put + rest * np.uint64(STEP), other),  # put in before j
                (1, whole + put - (value[:, j : j + 1] * power[j] if j < n else 0), other),  # in place of j
            ):
                if shift and j == n:
                    continue
                word, c = np.nonzero(valid & wanted(mix(hashes).ravel()).reshape(hashes.shape))
                if len(word):
                    yield word, np.concatenate([words[word, :j], alphabet[c][:, None], words[word, j + shift :]], axis=1)
            if j < n:
                hashes = sums[:, j] + (whole[:, 0] - sums[:, j + 1]) * np.uint64(BACK)
                last = words[:, j] != words[:, j + 1] if j + 1 < n else np.ones(len(words), bool)
                word = np.flatnonzero(last & wanted(mix(hashes)))
                if len(word) and n > 1:
                    yield word, np.concatenate([words[word, :j], words[word, j + 1 :]], axis=1)


def _edits(bitmap: np.ndarray, alphabet: np.ndarray):
    def run(batches):
        for rb in batches:
            own = rb.column("word")
            for at, words in _groups(*_letters(own)):
                for word, made in edits(words, alphabet, lambda h: in_filter(bitmap, h)):
                    raw, n = made.tobytes(), made.shape[1]
                    near = [raw[i : i + n].decode("latin-1") for i in range(0, len(raw), n)]
                    yield out_batch(NEAR, own.take(pa.array(at[word])), near)

    return run


def neighbours(work: Work, vocab: DataFrame) -> DataFrame:
    """word, near, n: all pairs of words of a table (word, n) that one edit makes of each other, both ways, with the n of
    near. A word of L letters has at most 2 L times the number of letters (90) neighbours."""
    # at most 256 rows: which letters occur
    alphabet = np.array(sorted(r.c for r in vocab.mapInArrow(_alphabet, "c long").distinct().collect()), np.uint8)
    keys = vocab.mapInArrow(_hash, "h long")
    bitmap = key_filter(keys, "h", vocab.count())
    made = vocab.select("word").mapInArrow(_edits(bitmap, alphabet), "word string, near string")
    # Spark sizes what is made by its input, a word a row, and would broadcast it
    return made.join(vocab.select(F.col("word").alias("near"), "n").hint("merge"), "near").select("word", "near", "n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, seen: int = SEEN, factor: int = FACTOR, typos: int = 0) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near (words one edit away), form (the most frequent of these, if at least
    factor times as frequent as the word, else null), form_n (its n) and root (the end of the chain of forms)."""
    work = Work(docs.sparkSession, "spelling")
    vocab = work.write(vocabulary(docs, id_col, text_col, letters, seen, typos), "vocab")
    best = neighbours(work, vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("b"))
    most, form = -F.col("b.m"), F.col("b.near")
    enough = most >= factor * F.col("n")
    rows = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, form).alias("form"), F.when(enough, most).alias("form_n"))
    rows = work.write(rows, "rows")
    roots, k, open_ = work.write(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0, 1
    while open_:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step = work.write(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), f"roots{k + 1}")
        work.drop(f"roots{k}")
        roots, k, open_ = step.select("word", "root"), k + 1, step.where("moved").limit(1).count()
    out = rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = work.write(out, "variants")
    work.only("variants")
    return out


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typos=TYPOS)
