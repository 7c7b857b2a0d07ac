"""Substring dedup by level-wise doubling.

Words covered by a window of `window` words that also starts in a document with a smaller id are removed.

Level 1 looks at windows of `base` words, but only at those that have the least hash among the ones inside some full
window (a minimiser), so about 2 / (window - base + 2) of all positions travel. A repeated full window has a repeated
minimiser, so nothing is lost. Each further level doubles the length: only windows whose halves repeated at the last
level are hashed and counted, until the full length is reached or no candidate is left. What repeats at a level goes to
the next as a bitmap of bounded size (see common.key_filter); a false hit there only costs a row, for the last level
compares hashes of the full windows exactly. Counts are minima and maxima of ids by window hash, so they are combined
before the shuffle and a passage that a third of all documents share is a small row for each task.

Defined results: null or empty text and fewer than `window` words: nothing is removed; a repeat inside one document, or
in rows with the same id: kept, and each such row loses what its own text repeats; null id: the row takes no part and is
returned whole; further columns are not looked at.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import Work, as_long, find_words, free_name, in_filter, key_filter, longs, out_batch, rows_of, slices, window_hashes, with_types, word_hashes

WINDOW, BASE = 13, 7


def levels(window: int, base: int) -> list[int]:
    """Lengths of the windows: base, then doubled up to the full window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def least(h: np.ndarray, k: int) -> np.ndarray:
    """Least of each k neighbours."""
    have = 1
    while have < k:
        step = min(have, k - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def _windows(data, off, ids, ok, window, lens, filters):
    """Hash, row and first word of the candidates of the level that has as many filters below it."""
    starts, ends, tok = find_words(data, off)
    n = len(starts) - window + 1
    if n <= 0:
        return None
    words, row = word_hashes(data, starts, ends), rows_of(tok)
    whole = (row[:n] == row[window - 1 :]) & ok[row[:n]]
    seeds = least(window_hashes(words, lens[0]), window - lens[0] + 1)
    if not filters:
        first = np.empty(n, bool)
        first[:1], first[1:] = True, (seeds[1:] != seeds[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
        at = np.flatnonzero(whole & first)
        return seeds[at], row[at], at, tok
    hit = whole & in_filter(filters[0], seeds)
    # a full window is a candidate while all its windows of the last length that lie on its start and its end repeat
    for length, bitmap in zip(lens[1:], filters[1:], strict=False):
        h = in_filter(bitmap, window_hashes(words, length))
        hit &= h[:n] & h[window - length : window - length + n]
    length = lens[len(filters)]
    if length == window:
        at = np.flatnonzero(hit)
        return window_hashes(words, window)[at], row[at], at, tok
    at = np.flatnonzero(hit)
    at = np.unique(np.concatenate([at, at + window - length]))
    return window_hashes(words, length)[at], row[at], at, tok


OCC = pa.schema([("h", pa.int64()), ("id", pa.int64())])
POS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("at", pa.int32())])


def _level(window, lens, filters, with_at=False):
    def run(batches):
        for rb, data, off in slices(batches):
            ids, ok = longs(rb.column("id"))
            got = _windows(data, off, ids, ok, window, lens, filters)
            if got is not None:
                h, row, at, tok = got
                cols = (as_long(h), ids[row])
                yield out_batch(POS, *cols, np.asarray(rb.column("t"))[row], (at - tok[row]).astype(np.int32)) if with_at else out_batch(OCC, *cols)

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE, work: Work | None = None) -> DataFrame:
    """A row (id, t, at int[]) for each document with windows to remove: the first words of those windows, ascending. t is
    the hash of its text: rows that share an id but not the text are documents of their own."""
    work, rows = work or Work(docs.sparkSession, "substrings"), with_types(docs, id_col, text_col)
    lens, filters = levels(window, base), []
    if len(lens) == 1:
        lens = [window, window]
    for k in range(len(lens) - 1):
        occ = rows.mapInArrow(_level(window, lens, filters), "h long, id long")
        again = occ.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
        kept = work.write(again, f"level{k}")
        filters.append(key_filter(kept, "h", kept.count()))
        work.drop(f"level{k}")
        if not filters[-1].any():
            return docs.sparkSession.createDataFrame([], "id long, t long, at array<int>")
    # the candidates are made twice rather than kept: that costs less disk
    occ = rows.withColumn("t", F.xxhash64("text")).mapInArrow(_level(window, lens, filters, True), "h long, id long, t long, at int")
    # a table of its own, so that the join deals both sides and a passage of very many documents can be split
    first = work.write(occ.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "lo"), "first")
    hits = occ.join(first, "h").where("id > lo")
    out = work.write(hits.groupBy("id", "t").agg(F.sort_array(F.collect_set("at")).alias("at")), "spans", compression="zstd")
    work.only("spans")
    return out


CUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept_words(data, off, lists, window):
    """Number of words, of removed words, and the kept ones joined, for each row with its windows to remove."""
    starts, ends, tok = find_words(data, off)
    gone = np.zeros(len(starts) + 1, np.int32)
    reach, values = np.asarray(lists.offsets), np.asarray(lists.values)
    for i in np.flatnonzero(np.diff(reach)).tolist():
        at = values[reach[i] : reach[i + 1]] + tok[i]
        np.add.at(gone, at, 1)
        np.add.at(gone, np.minimum(at + window, tok[i + 1]), -1)
    gone = np.cumsum(gone[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    raw, texts = data.tobytes(), []
    keep = np.flatnonzero(~gone)
    s, e, at = starts[keep].tolist(), ends[keep].tolist(), np.searchsorted(keep, tok).tolist()
    for i in range(len(off) - 1):
        texts.append(b" ".join([raw[a:b] for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]], strict=True)]))
    return np.diff(tok), total[tok[1:]] - total[tok[:-1]], texts


def _cut(window):
    def run(batches):
        for rb, data, off in slices(batches):
            n, removed, texts = _kept_words(data, off, rb.column("at"), window)
            yield out_batch(CUT, rb.column("id"), n, removed, pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def _replace(window, names, text_col, span):
    def run(batches):
        for rb, data, off in slices(batches, text_col):
            _, removed, texts = _kept_words(data, off, rb.column(span), window)
            old = rb.column(text_col)
            new = pa.array([t if r else None for t, r in zip(texts, removed.tolist(), strict=True)], pa.binary()).cast(old.type)
            text = pc.if_else(pa.array(removed > 0), new, old)
            yield pa.RecordBatch.from_arrays([text if c == text_col else rb.column(c) for c in names], names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """docs with the words of repeated windows taken out of the text; texts without any stay as they are, to the byte."""
    own, key, span = free_name(docs, "__span_id"), free_name(docs, "__span_key"), free_name(docs, "__span_at")
    spans = repeated_windows(docs, id_col, text_col, window, base).select(F.col("id").alias(own), F.col("t").alias(key), F.col("at").alias(span))
    none = F.array().cast("array<int>")
    same = (docs[id_col] == spans[own]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans[key])
    rows = docs.join(spans, same, "left").select(*docs.columns, F.coalesce(span, none).alias(span))
    return rows.mapInArrow(_replace(window, docs.columns, text_col, span), docs.schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """Per row of docs: id, n_words, n_removed and the kept words joined by one space."""
    spans = repeated_windows(docs, id_col, text_col, window, base)
    none = F.array().cast("array<int>")
    rows = with_types(docs, id_col, text_col).withColumn("t", F.xxhash64("text")).join(spans, ["id", "t"], "left").select("id", "text", F.coalesce("at", none).alias("at"))
    return rows.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept string")



def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
