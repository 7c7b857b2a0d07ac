"""Fill-in-the-middle by a sparse checkpoint index.

Units are runs of A-Z, a-z and single other code points. They are counted piece by piece over the UTF-8 bytes; while
counting, the unit number, byte and code point are noted at each row's start and at every EVERY-th unit. A cut after some
units is found by binary search among these checkpoints and a look at the bytes from there to the next one. Memory is the
index and a piece, whatever the length of a text.

Prefix, middle and suffix follow from hashes of the seed and the id; the output joins them with three marks, in the order
prefix, suffix, middle (psm) or suffix, prefix, middle (spm), or is the text as it is (plain).

Defined results: null or empty text: plain and empty; a text that holds a mark: plain; null id: hashes of an empty id;
rows that share an id: cut by the same hashes, each within its own text; empty table: no rows; further columns are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import out_batch, slices, small_batches

#: Units between two checkpoints, bytes of a piece.
EVERY, PIECE = 64, 1 << 18
#: Of a hundred texts so many from here on stay plain, so many of the others are spm.
PLAIN, SPM = 90, 20
MARKS = ("<P>", "<S>", "<M>")

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True


def unit_starts(piece: np.ndarray, before: int) -> np.ndarray:
    """Where units start in some bytes, and whether: a letter not after a letter, or the first byte of another code point.
    before: the byte before the piece, or -1 at a row's start."""
    letter = IS_LETTER[piece]
    out = ~letter & ((piece & 0xC0) != 0x80)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    if before >= 0 and len(piece) and IS_LETTER[before]:
        first[0] = False
    return out | first


class Index:
    """Checkpoints over the texts of a slice, in order: units and code points before a byte."""

    def __init__(self, data: np.ndarray, off: np.ndarray, every: int = EVERY, piece: int = PIECE):
        self.data, self.off = data, off
        units, points, at = [], [], []
        n_units = n_points = 0
        edges = off[1:-1]
        for a in range(0, len(data), piece):
            part = data[a : a + piece]
            starts = unit_starts(part, int(data[a - 1]) if a else -1)
            # a row's first byte starts a unit, whatever stands before it
            lo, hi = np.searchsorted(edges, [a, a + len(part)])
            own = edges[lo:hi] - a
            starts[own] = True
            count, new = np.cumsum(starts), np.cumsum((part & 0xC0) != 0x80)
            here = np.flatnonzero(starts & ((n_units + count - 1) % every == 0))
            here = np.union1d(here, own)
            units.append(n_units + count[here] - 1)
            points.append(n_points + new[here] - 1)
            at.append(a + here)
            n_units, n_points = n_units + int(count[-1]), n_points + int(new[-1])
        self.units, self.points, self.at = (np.concatenate([*x, [end]]).astype(np.int64) for x, end in ((units, n_units), (points, n_points), (at, len(data))))
        # rows begin at checkpoints; an empty row where the next one begins
        first = np.searchsorted(self.at, off)
        self.first_unit, self.first_point = self.units[first], self.points[first]

    def cut(self, row: int, unit: int) -> tuple[int, int]:
        """Byte and code point (in the slice) at which the row's unit of that number starts, or the row's end."""
        if unit >= self.first_unit[row + 1] - self.first_unit[row]:
            return int(self.off[row + 1]), int(self.first_point[row + 1])
        want = int(self.first_unit[row]) + unit
        k = int(np.searchsorted(self.units, want, "right")) - 1
        a, b = int(self.at[k]), int(self.at[k + 1])
        part = self.data[a:b]
        starts = unit_starts(part, -1)
        i = int(np.flatnonzero(starts)[want - int(self.units[k])])
        return a + i, int(self.points[k]) + int(((part[:i] & 0xC0) != 0x80).sum())


OUT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(seed: int, plain: int, spm: int, marks: tuple[str, str, str]):
    tags = [m.encode() for m in marks]
    p, s, m = tags

    def run(batches):
        for rb, data, off in slices(batches):
            index, raw = Index(data, off), data.tobytes()
            units = np.diff(index.first_unit)
            form, prefix, middle, text = [], [], [], []
            for row, (i, n) in enumerate(zip(rb.column("id").to_pylist(), units.tolist(), strict=True)):
                a, b = int(off[row]), int(off[row + 1])
                digest = hashlib.sha256(b"%d:%s" % (seed, b"" if i is None else b"%d" % i)).digest()
                h = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]
                own = raw[a:b]
                if not n or h[2] % 100 >= plain or any(t in own for t in tags):
                    form.append("plain"), prefix.append(None), middle.append(None), text.append(own)
                    continue
                (x, x_point), (y, y_point) = (index.cut(row, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                parts = raw[a:x], raw[x:y], raw[y:b]
                prefix.append(x_point - int(index.first_point[row])), middle.append(y_point - x_point)
                if h[3] % 100 < spm:
                    form.append("spm"), text.append(b"".join((s, parts[2], p, parts[0], m, parts[1])))
                else:
                    form.append("psm"), text.append(b"".join((p, parts[0], s, parts[2], m, parts[1])))
            yield out_batch(OUT, rb.column("id"), units, form, prefix, middle, pa.array(text, pa.binary()).cast(pa.string()))

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.
    marks: of prefix, suffix and middle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_transform(seed, plain, spm, marks), "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No part of a text holds a mark, so marks part the output in one way."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = restored(F.col("form"), F.col("output"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
