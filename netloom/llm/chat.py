"""Chat formatting: logged snapshots of one conversation are collapsed, and the maximal ones rendered.

A log often holds a conversation after each turn, so one is a prefix of the next.  Each turn gets the hash of all turns
up to it: two running XORs of position-tagged hashes, 128 bits.  A conversation whose last hash is another one's hash at
the same place, with more turns after it, is removed by an anti-join; of conversations with equal turns the least
conv_id stays.  No conversation is compared with another one by its text, and no first turn, however common, brings
conversations together: the prefixes are a distinct set, built by partial aggregation.

Turns are in order of turn, then role and text; nulls come last, and a null role or text differs from an empty one.
Repeated rows are repeated turns.  Rows with a null conv_id make one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k (place, from 1), role, text and the hashes a and b of the turns up to k."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    rows = rows.withColumn("k", F.row_number().over(order))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    return rows.withColumn("a", F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(so_far)).withColumn("b", F.bit_xor(F.xxhash64(F.lit("b"), *parts)).over(so_far))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no other one."""
    marked = prefixes(turns).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).select("conv_id", "k", "n", "a", "b")
    full = marked.where("k = n").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count_if(F.col("conv_id").isNull()).alias("nulls"))
    proper = marked.where("k < n").select("k", "a", "b").distinct()
    return full.join(proper, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """conv_id, n_turns and rendered of the maximal conversations; a turn is start, role, line feed, text, end, line feed.

    A null role is written as "unknown", a null text as nothing.
    """
    kept = maximal(turns)
    rows = prefixes(turns).select("conv_id", "k", F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n")).alias("line"))
    own = kept.select(F.col("conv_id").alias("kept_id"), "n_turns")
    joined = rows.join(own, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return joined.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "").alias("rendered"))
