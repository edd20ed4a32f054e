"""Joins and numbering that hold when one key has a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.storage import written

HOT_ROWS = 1_000_000  # a key with fewer rows is left to one task
HOT_KEYS = 1_000      # the k-th most frequent key holds at most 1/k of all rows
SMALL_ROWS = 1_000_000
SAMPLE_ROWS = 20_000  # rows of a key that is just hot, expected in the sample it is looked for in


def fits(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether `df` has at most `max_rows` rows; a plain count, which a parquet table answers from its footers."""
    return df.count() <= max_rows


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> DataFrame | None:
    """The most frequent keys with more than `min_rows` rows, NULL counting as a key; None when there are none.

    Looked for now, so that a plan without hot keys stays a plain one, and in a sample where `min_rows` is large. At
    most HOT_KEYS rows come back, which can always be broadcast. The list only decides how work is spread: all
    rows are computed in either way, and a key that is not on it takes the ordinary one.
    """
    share = min(1.0, SAMPLE_ROWS / min_rows)
    looked = df.select(*keys) if share == 1 else df.select(*keys).sample(share, seed=1)
    enough = min_rows if share == 1 else 0.9 * share * min_rows
    counts = looked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > enough)
    top = counts.orderBy(F.desc("_rows")).limit(HOT_KEYS).select(*keys)
    rows = top.collect()
    return df.sparkSession.createDataFrame(rows, top.schema) if rows else None


def split_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys and the other rows, without moving either."""
    named = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(named, same, "left_semi"), df.join(named, same, "left_anti")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) with a right side that has one row per key.

    Rows of hot left keys stay where they are and meet a broadcast of the at most HOT_KEYS right rows they can
    match (counted, should keys repeat after all); the other rows take the ordinary join.
    """
    hot = hot_keys(left, on, min_rows)
    if hot is None:
        return left.join(right, on, how)
    busy, quiet = split_hot(left, hot, on)
    right_hot = right.join(F.broadcast(hot), on, "left_semi")
    if not fits(right_hot):
        return left.join(right, on, how)
    return busy.join(F.broadcast(right_hot), on, how).unionByName(quiet.join(right, on, how))


def suspects(large: DataFrame, small: DataFrame, keys: list[str], bits_per_row: int = 16) -> DataFrame:
    """The rows of `large` whose key may be among those of `small`: all that are, and a few others.

    The keys of `small` set bits of a bitmap, which is sent to where the rows of `large` lie (2^29 bits at most, 64 MB), so
    that rows without a match are left out before anything is shuffled. `small` should be a written table.
    """
    size = 1 << min(29, max(15, (bits_per_row * small.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    inside = place.bitwiseAND(F.lit(32_767))
    bitmaps = small.groupBy(F.shiftright(place, 15).alias("_map")).agg(F.bitmap_construct_agg(inside).alias("_bits"))
    met = large.withColumn("_map", F.shiftright(place, 15)).join(F.broadcast(written(bitmaps, "bitmaps")), "_map")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(inside, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, inside.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return met.where(bit == 1).drop("_map", "_bits")


def join_checked(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    sized_by: DataFrame | None = None,
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join a large left side with a right side of one row per key.

    `right` is broadcast when it is counted to have at most `max_rows` rows; beyond that the join moves both sides
    and keeps hot keys apart. `sized_by` is a cheaper frame with at least as many rows as `right`.
    """
    if fits(right if sized_by is None else sized_by, max_rows):
        return left.join(F.broadcast(right), on, how)
    return hot_join(left, right, on, how)


def dense_positions(df: DataFrame, key: str, out: str, width: int = 1_000_000) -> DataFrame:
    """0-based position of each row in the order of the unique column `key`; rows whose key is NULL are left out.

    A 32-bit integer is numbered inside ranges of `width` keys; only the range sizes, at most 4296 of them for the default
    width, are summed in one task and broadcast. Any other type is numbered by `sorted_positions`.
    """
    if df.schema[key].dataType != T.IntegerType():
        return sorted_positions(df, key, out)
    ranged = df.withColumn("_range", F.floor(F.col(key) / F.lit(width)).cast("int"))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .withColumn(out, (F.col("_before") + F.col("_inside") - 1).cast("int"))
        .drop("_range", "_inside", "_before")
    )


def sorted_positions(df: DataFrame, key: str, out: str, parts: int | None = None) -> DataFrame:
    """0-based 64-bit position of each row in the order of `key`, of any type that can be ordered.

    Rows are dealt over ranges, sorted there and written, a file per range; the place of a row in its file and the sizes of
    the files before it, one row per file, make its position. Keys that repeat are numbered in any one order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(key).isNotNull()).repartitionByRange(parts, key).sortWithinPartitions(key)
    placed = written(ranged, "ranges")
    place = placed.metadataColumn("_metadata")
    rows = placed.select("*", place["file_name"].alias("_file"), place["row_index"].alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "_file").withColumn(out, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
