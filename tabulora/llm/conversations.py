"""Chat formatting with cumulative-snapshot collapse.

A conversation that is logged after each turn leaves snapshots that begin longer ones. Each turn's hash holds its
number, role and text; the running exclusive-or of the turns' hashes (two of 64 bits) is the hash of that prefix. A
conversation is dropped if its whole hash is a proper prefix hash of another, by an anti-join of distinct hashes, and of
equal conversations the one with the least id stays. The rest is rendered. Hashes are combined before each shuffle, so
a first turn or a conversation that a third of the log repeats is one row for each task.

Defined results: turns are ordered by turn, role and text, nulls first; a row logged twice counts once; null role or
text: as empty; rows without conv_id belong to no conversation and are left out; a conversation with one empty turn: an
ordinary conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Text before the role, between role and text, and after the text of a turn.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def maximal_conversations(log: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the conversations (conv_id, turn, role, text) that begin no other one."""
    none = F.lit("")
    rows = log.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = rows.withColumn("k", F.row_number().over(order))
    turns = turns.withColumn("x", F.xxhash64("k", "role", "text")).withColumn("y", F.xxhash64("text", F.lit("|"), "role", "k"))
    turns = turns.select("conv_id", "k", F.expr("bit_xor(x)").over(sofar).alias("x"), F.expr("bit_xor(y)").over(sofar).alias("y"), F.lead("k").over(order).isNull().alias("whole"))
    key = ["k", "x", "y"]
    whole = turns.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    prefixes = turns.where("not whole").select(*key).distinct()
    kept = whole.join(prefixes, key, "left_anti").select("conv_id")
    said = rows.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(OPEN), t.role, F.lit(BETWEEN), t.text, F.lit(CLOSE))
    return said.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("rendered"))


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
