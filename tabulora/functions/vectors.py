"""Vectors: feature hashing, dot product, cosine and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulora.functions.text import _col
from tabulora.functions.tokens import simple_tokens


def bucket(token: Column, dim: int) -> Column:
    """The token's md5 as a big-endian number, modulo dim, from two halves of 64 bits."""
    if dim & (dim - 1) == 0 and dim <= 1 << 32:
        # a power of two is a matter of the last digits
        return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 25, 8), 16, 10).cast("long"), F.lit(dim))
    half = lambda at: F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), at, 16), 16, 10).cast("decimal(20,0)"), F.lit(dim).cast("decimal(20,0)")).cast("long")
    return F.pmod(half(1) * F.lit((1 << 64) % dim) + half(17), F.lit(dim))


def hashed_counts(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, idx, value): the unit vector of the token counts, only its entries that are not zero."""
    places = F.transform(simple_tokens(text), lambda t: bucket(t, dim).cast("int"))
    # a row has at most dim places, and only those are exchanged; the norm is taken where a key's places already lie
    parts = df.select(key, F.explode(places).alias("idx")).groupBy(key, "idx").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return parts.withColumn("norm", norm).select(key, "idx", (F.col("n") / F.col("norm")).alias("value"))


def hashed_vector(text, dim: int) -> Column:
    """The same as a dense array, for texts that are short: no tokens give zeros."""
    at = F.transform(simple_tokens(text), lambda t: bucket(t, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    norm = F.sqrt(dot(counts, counts))
    return F.transform(counts, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def dot(a, b) -> Column:
    """Sum of products over the places that both have."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    product = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    """Null if the dimensions differ or a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(_col(a)) == F.size(_col(b))) & (size > 0), dot(a, b) / size)


def parsed(s) -> Column:
    """A vector from its text form, or null."""
    return F.from_json(_col(s), "array<double>")


def as_literal(v) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), lambda x: x.cast("string")), ","), F.lit("]"))
