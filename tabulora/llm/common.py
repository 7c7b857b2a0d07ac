"""What the operators share: a shared work folder, bounded filters, and vectorised words of Arrow batches.

Words are `[^\\x20\\x09-\\x0D]+`. They are found and hashed with numpy over the UTF-8 bytes of a whole Arrow batch, in
slices of a few megabytes, so memory does not depend on the table and no Python string is made per word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- work folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a single machine without that setting (tests)
    a local folder serves; on a cluster without it this is an error, for executors do not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="tabulora-")
        base = _LOCAL["dir"]
    return base.rstrip("/")


_LOCAL: dict = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes of an Arrow batch; with Spark's defaults one would hold tens of megabytes of long documents.
BATCH, BATCH_BYTES = "2000", "8m"
#: Spark's own setting: shuffle files of an SQL execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a bucket, and most buckets of a small table.
BUCKET, FEW = 4 << 20, 16


class Work:
    """Tables of one call in a folder of their own under the shared one; what is written cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        small_batches(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes a table and reads it back."""
        path = f"{self.at}/{name}"
        self.write_at(df, path, **options)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_at(self, df: DataFrame, path: str, format: str = "parquet", **options) -> None:
        """Writes a table anywhere; the shuffles that made it are not needed any more and go."""
        with self.cleaned():
            df.write.format(format).options(**options).save(path)

    @contextmanager
    def cleaned(self) -> Iterator[None]:
        """Shuffles of what is planned and run in here go with its end."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def buckets(self, df: DataFrame, name: str, key: str, n_bytes: int | None = None) -> DataFrame:
        """Writes a table of about n_bytes dealt out by a key: joins by the key read it where it lies and move the other
        side alone. Buckets are as many as shuffles have partitions; of a table that a few tasks hold, as few as those."""
        n = FEW + 1 if n_bytes is None else n_bytes // BUCKET + 1
        if n <= FEW < partitions(self.spark):
            df = df.coalesce(n)
        else:
            n = partitions(self.spark)
        table = self.tables[name] = f"tabulora_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(n, key).sortBy(key).option("path", f"{self.at}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing lazy still reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
            _delete(self.spark, f"{self.at}/{name}")

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*[name for name in self.tables if name not in names])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if s.getPath().getName() not in names:
                _delete(self.spark, str(s.getPath().toString()))

    def close(self) -> None:
        try:
            self.drop(*list(self.tables))
            _delete(self.spark, self.at)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default size of Arrow batches; a size that the user has set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_types(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text under fixed names, so that further columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, longer by underscores while the table has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- bounded filter
#: Most bits of a filter: 32 MB. This bounds what is broadcast, whatever the data.
FILTER_BITS = 1 << 28


def key_filter(keys: DataFrame, col: str, n_keys: int, most: int = FILTER_BITS) -> np.ndarray:
    """A bitmap with two bits set for each key (bigint): a Bloom filter.

    Its size follows the number of keys up to `most` bits, so it is safe to ship. A set bit may be another key's:
    users must check hits exactly; a full bitmap costs time and shuffle, never rows.
    """
    bits = 1 << 20
    while bits < 16 * n_keys and bits < most:
        bits *= 2
    shift = bits.bit_length() - 1
    key = F.col(col)
    both = F.explode(F.array(F.pmod(key, F.lit(bits)), F.pmod(F.shiftrightunsigned(key, shift), F.lit(bits)))).alias("v")
    v = F.col("v") + 1
    rows = (
        keys.where(key.isNotNull()).select(both)
        .select(F.bitmap_bucket_number(v).alias("b"), F.bitmap_bit_position(v).alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    )
    out = np.zeros(bits // 8, np.uint8)
    # at most `most` / 8 bytes in all, so one job brings them
    for r in rows.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key (int64 or the same bits as uint64) whether its bits are set."""
    bits = len(bitmap) * 8
    low = np.uint64(bits - 1)

    def probe(x):
        at = x & low
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    keys = keys.view(np.uint64)
    out = probe(keys)
    some = np.flatnonzero(out)
    out[some] = probe(keys[some] >> np.uint64(bits.bit_length() - 1))
    return out


# ---------------------------------------------------------------- Arrow columns
def text_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (one more than rows); nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


#: Rows of a slice, so that a row's number fits in 13 bits.
ROWS = 8000


def slices(batches, text: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes of text (a longer row stands alone): the rows, bytes, offsets."""
    for rb in batches:
        data, off = text_of(rb.column(text))
        i = 0
        while i < rb.num_rows:
            j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), i + ROWS)
            yield rb.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def longs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and validity of a bigint column; nulls are 0."""
    ok = np.asarray(col.is_valid())
    return np.asarray(col.fill_null(0) if col.null_count else col), ok


def strings(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


# ---------------------------------------------------------------- words
def _splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = _splitmix(20011, 256)
STEP = 0x5851F42D4C957F2D
BACK = pow(STEP, -1, 1 << 64)
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        have = 1
        while have < n:
            k = min(have, n - have)
            out[have : have + k] = out[:k] * np.uint64(pow(base, have, 1 << 64))
            have += k
    return out


_CACHE: dict = {}


def find_words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = BREAKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row (and the end) the index of its first word."""
    n = len(data)
    inside = ~breaks[data]
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[n - 1 :], after[: n - 1] = False, inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over random values of its bytes, from prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
            a, b = starts[i], int(ends[i:j].max())
            size = max(_PIECE, int(b - a))
            if _CACHE.get("size", 0) < size:
                _CACHE.update(size=size, up=_powers(STEP, size + 1), down=_powers(BACK, size + 1))
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data[a:b]] * _CACHE["up"][: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _CACHE["down"][s]
            i = j
    return mix(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; len(words) - k + 1 of them (none if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h *= np.uint64(STEP)
            h += words[j : j + n]
    return mix(h)


def rows_of(tok_off: np.ndarray) -> np.ndarray:
    """For each word the index of its row."""
    return np.repeat(np.arange(len(tok_off) - 1), np.diff(tok_off))


def out_batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


