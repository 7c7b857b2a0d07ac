"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes runs along the text. A boundary stands where the hash has STRICT zero bits, or, once
a chunk has reached the normal length, where it has LOOSE ones (normalised chunking); chunks have LEAST to MOST bytes.
Boundaries depend on nearby bytes alone, so a change moves only the chunks around it. The fingerprint is the set of
chunk digests (40 bits) with the chunks' lengths, as hex text in ascending order; the likeness of two is the share of
one's length whose chunks the other has (containment).

Defined results: null or empty text: an empty fingerprint, of likeness 1 to an empty one and 0 to others; equal texts:
equal fingerprints; text shorter than LEAST: one chunk. Order of documents: by id, nulls first, ties by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import _splitmix, longs, out_batch, partitions, small_batches, word_hashes

LEAST, NORMAL, MOST = 16, 32, 128
STRICT, LOOSE = 5, 3
GEAR = (_splitmix(7919, 256) >> np.uint64(32)).astype(np.uint32)
REACH = 16


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last REACH bytes at each byte: h = 2 h + value, of which 16 shifts leave the high bits' sum."""
    h, have = GEAR[data], 1
    while have < REACH:
        g = h.copy()
        g[have:] += h[:-have] << np.uint32(have)
        h, have = g, have * 2
    return h


def chunk(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every chunk, row by row."""
    # bits 11 to 15 depend on no byte farther back than REACH
    h = gear(data)
    loose = (h & np.uint32(((1 << LOOSE) - 1) << (16 - LOOSE))) == 0
    cut = np.flatnonzero(loose) + 1
    strict = np.flatnonzero((h & np.uint32(((1 << STRICT) - 1) << (16 - STRICT))) == 0) + 1
    far = np.int64(len(data) + MOST)
    cut, strict = np.append(cut, far), np.append(strict, far)
    live = np.flatnonzero(np.diff(off) > 0)
    at, end = off[live], off[live + 1]
    starts, ends, rows = [], [], []
    while len(live):
        s = strict[np.searchsorted(strict, at + LEAST)]
        c = cut[np.searchsorted(cut, at + NORMAL)]
        to = np.minimum(np.where(s < at + NORMAL, s, np.minimum(c, at + MOST)), end)
        starts.append(at)
        ends.append(to)
        rows.append(live)
        go = to < end
        live, at, end = live[go], to[go], end[go]
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    s, e, r = np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)
    order = np.lexsort((s, r))
    return s[order], e[order], r[order]


def prints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests with lengths (digest << 8 | length), ascending in each row, and where each row's begin."""
    s, e, row = chunk(data, off)
    value = (word_hashes(data, s, e) >> np.uint64(24) << np.uint64(8)) | (e - s).astype(np.uint64)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(off)))


def as_text(value: np.ndarray, at: np.ndarray) -> list[str]:
    """12 hex digits for each chunk: digest and length."""
    raw = np.ascontiguousarray(value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes().hex()
    b = (at * 12).tolist()
    return [raw[i:j] for i, j in zip(b[:-1], b[1:], strict=True)]


def likeness(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Share of the length of each row of a that is in chunks of the same row of b."""
    n = len(at) - 1
    row_a, row_b = np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(n), np.diff(bt))
    size = (a & np.uint64(255)).astype(np.int64)
    with np.errstate(over="ignore"):
        # the row goes into the value by a bijection of the digest bits, so that rows do not meet
        key_a = a * np.uint64(0x9E3779B97F4A7C15) + row_a.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        key_b = b * np.uint64(0x9E3779B97F4A7C15) + row_b.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    both = np.isin(key_a, key_b)
    whole = np.bincount(row_a, size, n)
    shared = np.bincount(row_a[both], size[both], n)
    return np.where(whole > 0, shared / np.maximum(whole, 1), (np.diff(bt) == 0).astype(float))


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _finish(rows: list[tuple], after: str | None):
    """Results of rows (id, text), each followed by the next; the last by `after`."""
    texts = [t for _, t in rows]
    follow = [*texts[1:], after if after is not None else ""]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, follow, strict=True)]
    raw, new = [t.encode() for t in (*texts, follow[-1])], [t.encode() for t in edited]
    own, at = prints(*_join(raw))
    ed, et = prints(*_join(new))
    cut = at[-2]
    near_next = likeness(own[:cut], at[:-1], own[at[1] :], at[1:] - at[1])
    return out_batch(
        OUT, [i for i, _ in rows], [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in new],
        as_text(own[:cut], at[:-1]), as_text(ed, et), likeness(own[:cut], at[:-1], ed, et), near_next,
    )


OUT_SQL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Code points of text, and rows, that are worked on at once.
TEXT, ROWS = 6 << 20, 4000


def _with_next(batches):
    """Rows sorted by place; a guest (the first of the next part) stands last and only serves the one before it."""
    held: list[tuple] = []
    size = 0
    for rb in batches:
        for i, text, guest in zip(rb.column("id").to_pylist(), rb.column("text").to_pylist(), rb.column("guest").to_pylist(), strict=True):
            if guest:
                if held:
                    yield _finish(held, text)
                held = []
                continue
            if held and (size + len(text) > TEXT or len(held) >= ROWS):
                yield _finish(held, text)
                held, size = [], 0
            held.append((i, text))
            size += len(text)
    if held:
        yield _finish(held, None)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the first half's worth of the next text.

    Documents are dealt by ranges of ids into sorted parts. The first document of each part also goes to the part before
    it (that of the first part to the last), so each finds its next one without a global sort in one task. Bounds of
    the parts are quantiles of the ids; many rows of one id share a part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("x"))
    n = partitions(spark)
    cuts = rows.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)
    # a row for each part: as many as there are partitions, whatever the data
    place = F.struct(F.col("id"), F.col("x"))
    placed = rows.select("id", "x").mapInArrow(_part_of(cuts), "id long, x long, part int")
    firsts = sorted(placed.groupBy("part").agg(F.min(place).alias("p")).collect())
    if not firsts:
        return spark.createDataFrame([], OUT_SQL)
    every = rows.mapInArrow(_deal(cuts, np.array([r.part for r in firsts]), {(r.p.id, r.p.x): (k - 1) % len(firsts) for k, r in enumerate(firsts)}), "id long, text string, x long, guest boolean, part int")
    dealt = every.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("guest", F.col("id").asc_nulls_first(), "x")
    return dealt.select("id", "text", "guest").mapInArrow(_with_next, OUT_SQL)


def _parts(rb, cuts) -> np.ndarray:
    """Part of each row's id among the bounds; nulls come first."""
    ids, ok = longs(rb.column("id"))
    return np.where(ok, np.searchsorted(cuts, ids, "right"), 0)


def _part_of(cuts):
    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("x"), pa.array(_parts(rb, cuts), pa.int32())], names=["id", "x", "part"])

    return run


def _deal(cuts, parts, heads):
    """Rows with the number of their part, and the first of each part once more as a guest of the part before."""
    names = ["id", "text", "x", "guest", "part"]

    def of(rb, guest, part):
        return pa.RecordBatch.from_arrays([rb.column("id"), rb.column("text"), rb.column("x"), pa.array(np.full(rb.num_rows, guest)), pa.array(part, pa.int32())], names=names)

    def run(batches):
        for rb in batches:
            yield of(rb, False, np.searchsorted(parts, _parts(rb, cuts)))
            back = [heads.get(k, -1) for k in zip(rb.column("id").to_pylist(), rb.column("x").to_pylist(), strict=True)]
            at = [k for k, p in enumerate(back) if p >= 0]
            if at:
                yield of(rb.take(pa.array(at)), True, np.array([back[k] for k in at]))

    return run


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
