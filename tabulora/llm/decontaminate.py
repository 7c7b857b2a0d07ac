"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the ones of a fixed mask, so it stays the same when a word under a zero is replaced.
Seeds of the benchmark and of the documents meet in a join; each hit sets an item against a document at one shift, and
there the words are compared place by place. An item is in a document if some WINDOW places in a row (the whole item,
if it is shorter) have at least SHARE equal words. Words are split at white space, A-Z lower-cased. FAMILIES holds masks
for each length of the window, such that however the allowed words are replaced some mask at some place misses them all:
what the rule accepts shares a seed. Documents give seeds only for the lengths that the benchmark has.

All of it is DataFrame expressions. The benchmark's seeds are shipped to the documents only while they are few (counted
first, SHIP at most); beyond that both sides are dealt out by seed, after the documents' seeds have been made distinct.
Only hits are carried on, as numbers; documents with hits are met again by a key of id and text. A seed that is common
in the benchmark gives a hit for each of its places, all of which count; those at one shift are one.

Defined results: null or empty text: no rows; items of up to three words: found as exact copies, the first of which is
reported; equal items: a row for each; null id: reported with a null id; repeated rows: reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASKS = ("11101011", "110110011")
WINDOW, SHARE = 13, 0.75
#: Masks by the length of the window; MASKS alone miss 58 of the 286 ways to replace three words of thirteen.
FAMILIES = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("111", "1101", "1011"),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111101", "110111"),
    8: ("11011", "1111", "1100011"),
    9: ("111011", "111101", "1001111", "11010011"),
    10: ("111011", "1101011", "1110011"),
    11: ("1110111", "1111011", "111001011", "110100111"),
    12: ("111011", "110111", "11010011", "110001011"),
    13: (*MASKS, "11010000111", "111111", "110000101011", "1110001011"),
}
ALL_MASKS = sorted({m for family in FAMILIES.values() for m in family})
#: Windows of up to so many words must be equal in all of them, so their seeds are whole items.
WHOLE = 3
#: Most benchmark seeds that are shipped.
SHIP = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shifted(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def seeds(rows: DataFrame, key: str, masks: list[str], lengths: list[int] | None = None) -> DataFrame:
    """(key, s0, s1, ..., at) for rows (key, h array of word hashes): each place where each mask fits; with lengths, only
    masks of the row's own family."""
    wide = max(len(m) for m in masks)
    short = min(len(m) for m in masks)
    fits = rows.where(F.size("h") >= short)
    # words side by side: column k is the word k places on, so that hashing runs in generated code
    sides = F.arrays_zip(*[F.slice("h", F.lit(k + 1), F.greatest(F.size("h") - k, F.lit(0))).alias(f"w{k}") for k in range(wide)])
    flat = fits.select(key, F.least(F.size("h"), F.lit(WINDOW)).alias("length"), F.posexplode(sides).alias("at", "w")).select(key, "length", "at", "w.*")
    each = []
    for m in masks:
        there = F.col(f"w{len(m) - 1}").isNotNull()
        if lengths is not None:
            there &= F.col("length").isin([n for n in lengths if m in FAMILIES[n]])
        each.append(F.when(there, F.xxhash64(*[F.col(f"w{k}") for k in _shifted(m)], F.lit(ALL_MASKS.index(m)))))
    return flat.select(key, "at", *[e.alias(f"s{n}") for n, e in enumerate(each)])


def _long(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.select(key, "at", F.expr(f"stack({n}, {', '.join(f's{k}' for k in range(n))})").alias("seed")).where("seed is not null")


def _best(equal: Column) -> Column:
    """Most equal places in any WINDOW of them in a row, as a share of the window."""
    n = F.size(equal)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda s: F.aggregate(F.slice(equal, s, WINDOW), F.lit(0), lambda t, x: t + x))
    return F.array_max(runs) / F.least(n, F.lit(WINDOW))


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, at (first word of the item in the document, may be negative), n_equal, n_item, share: the best shift
    of each item in each document that holds it."""
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    items = bench.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).select("item_id", hashed("w").alias("g"))
    items = items.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "g"))
    lengths = sorted(r.n for r in items.select(F.least(F.size("g"), F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()) or [WINDOW]
    masks = [m for m in ALL_MASKS if any(m in FAMILIES[n] for n in lengths)]
    test = _long(seeds(items.select("item", F.col("g").alias("h")), "item", masks, lengths), "item", len(masks))
    test = test.join(items.select("item", (F.size("g") <= WHOLE).alias("whole")).distinct(), "item").select("seed", "item", F.col("at").alias("item_at"), "whole").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    made = seeds(rows.select("key", hashed(words(F.col("text"))).alias("h")), "key", masks)
    few = test.limit(SHIP + 1).count() <= SHIP
    train = _long(made, "key", len(masks))
    hits = train.join(F.broadcast(test) if few else test, "seed")
    shift = F.col("at") - F.col("item_at")
    # copies of a whole item are all alike, so the first one is the best
    shifts = hits.groupBy("key", "item", F.when(~F.col("whole"), shift).alias("each")).agg(F.min(shift).alias("shift")).select("key", "item", "shift")
    found = rows.join(shifts, "key").select("id", "key", "item", "shift", hashed(words(F.col("text"))).alias("h"))
    found = found.join(items, "item")
    place = F.sequence(F.lit(1), F.size("g"))
    equal = F.transform(place, lambda j: F.when(F.get("h", j - 1 + F.col("shift")) == F.get("g", j - 1), 1).otherwise(0))
    found = found.select("id", "key", "item_id", "item", "shift", F.size("g").alias("n_item"), equal.alias("equal"))
    total = F.aggregate("equal", F.lit(0), lambda t, x: t + x)
    found = found.select("id", "key", "item_id", "item", "shift", "n_item", total.cast("long").alias("n_equal"), _best(F.col("equal")).alias("share")).where(F.col("share") >= SHARE)
    best = F.max(F.struct("share", "n_equal", -F.col("shift"))).alias("b")
    got = found.groupBy("id", "key", "item_id", "item").agg(F.max("n_item").cast("long").alias("n_item"), best)
    return got.select("id", "key", "item_id", (-F.col("b.col3")).cast("long").alias("at"), F.col("b.n_equal").alias("n_equal"), "n_item", F.col("b.share").alias("share"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(docs, bench).select(F.col("id").alias("doc_id"), "item_id", F.col("at").alias("item_at"), "n_equal", "n_item", "share")
