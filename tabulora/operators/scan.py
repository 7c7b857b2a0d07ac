"""Ordered scans by key in two levels, so that a key with very many rows is not one task's work.

Rows of a key are cut into blocks by an expression that grows with the order. What a block hands on is one small row;
those rows are scanned by key, and each block starts from what the ones before it hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with columns without nulls that say what `names` say, and the names of those: windows, sums and an equi-join by
    them share one exchange of the rows."""
    made = {f"_e_{n}": F.coalesce(n, F.lit(0).cast(rows.schema[n].dataType)) for n in names}
    nulls = sum((F.when(F.col(n).isNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return rows.withColumns(made | {"_e": nulls}), [*made, "_e"]


def carry(rows: DataFrame, keys: list[str], order: list[str], block: Column, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """rows with, by name, the last (or first) value that is not null among the rows of the key before this one."""
    last, first = last or {}, first or {}
    names = [*keys, "_block"]
    rows, same = _keyed(rows.withColumn("_block", block).withColumns({f"_v_{n}": c for n, c in {**last, **first}.items()}), names)
    before = Window.partitionBy(*same).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.struct(*order).alias("o"), F.col(f"_v_{n}").alias("v")))
    heads = rows.groupBy(*names, *same).agg(*[F.max(known(n)).alias(f"_h_{n}") for n in last], *[F.min(known(n)).alias(f"_h_{n}") for n in first])
    heads = heads.select(*same, *[F.last(f"_h_{n}.v", ignorenulls=True).over(across).alias(f"_h_{n}") for n in last], *[F.first(f"_h_{n}.v", ignorenulls=True).over(across).alias(f"_h_{n}") for n in first])
    rows = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in last} | {f"_l_{n}": F.first(f"_v_{n}", ignorenulls=True).over(before) for n in first})
    out = rows.join(heads, same, "left")
    out = out.withColumns({n: F.coalesce(f"_l_{n}", f"_h_{n}") for n in last} | {n: F.coalesce(f"_h_{n}", f"_l_{n}") for n in first})
    return out.drop("_block", *same, *[f"_{p}_{n}" for p in "vlh" for n in (*last, *first)])


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """rows with their place in the key's order, from 0."""
    names = [*keys, "_block"]
    rows, same = _keyed(rows.withColumn("_block", block), names)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*names, *same).agg(F.count("*").alias("_n")).select(*same, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_n"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*same).orderBy(*order)) - 1)
    return rows.join(heads, same, "left").withColumn(name, F.col("_i") + F.col("_n")).drop("_block", "_i", "_n", *same)
