"""Chats from logs of cumulative snapshots.

A conversation is often logged again after each turn, under a new id. Rolling hashes of its turn prefixes tell which
logged conversations are the beginning of a longer one: an anti join of whole-conversation hashes with the hashes of
proper prefixes leaves the maximal conversations, and only those are rendered.

Defined results: rows of a conversation are ordered by (turn, role, text), NULL first; a row that repeats all four
values counts once; role and text NULL render as empty; rows without a conversation id form one conversation of their
own; of equal conversations the smallest id stands for all (`n_copies`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUM = "decimal(38,0)"


def turn_hash(seed: int) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    missing = [F.col(c).isNull() for c in ("role", "text")]
    return F.xxhash64(F.lit(seed), "position", *parts, *missing).cast(SUM)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its position, the length of its conversation and two hashes of all turns up to it.

    A hash is the running sum of the turns' own hashes, each with its position: one pass over sorted rows, no list.
    """
    same = Window.partitionBy("conv_id")
    order = same.orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(F.struct("turn", "role", "text")).over(order)
    once = (
        turns.withColumn("_before", before)
        .where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct("turn", "role", "text")))
        .drop("_before")
    )
    return (
        once.withColumn("position", F.row_number().over(order))
        .withColumn("turns", F.count(F.lit(1)).over(same))
        .withColumn("hash_a", F.sum(turn_hash(1)).over(up_to))
        .withColumn("hash_b", F.sum(turn_hash(2)).over(up_to))
        .select("conv_id", "position", "turns", "hash_a", "hash_b")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that begin no longer one."""
    hashed = prefixes(turns)
    whole = (
        hashed.where("position = turns")
        .groupBy("turns", "hash_a", "hash_b")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    parts = hashed.where("position < turns").select(F.col("position").alias("turns"), "hash_a", "hash_b").distinct()
    kept = whole.join(parts, ["turns", "hash_a", "hash_b"], "left_anti")
    return kept.select("conv_id", F.col("turns").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, chat): the turns of each conversation in order, each between start and end marks."""
    line = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    rows = F.sort_array(F.collect_set(F.struct("turn", "role", "text", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("chat"))


def chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of the maximal conversations of (conv_id, turn, role, text) rows."""
    rows = turns.select("conv_id", "turn", "role", "text")
    kept = maximal(rows)
    alone = kept.select(F.col("conv_id").alias("_id"))
    chosen = rows.join(alone, F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = rendered(chosen).withColumnRenamed("conv_id", "_id")
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
