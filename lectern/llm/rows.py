"""Rows of a table by number, and the table without some of them, with no wide row moved.

A row is numbered by the file it lies in and its place there, so that it has the same number whenever the table is read, and no
copy of the table is needed for it. Rows that go are bits: one bit a row, in maps of MAP rows that are sent to where
the rows lie.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.data import packed
from lectern.sources.storage import written

FILE_BITS = 40           # rows of a file, as a power of two
MAP_BITS = 15            # rows of a map, as a power of two; a map has 4 KB
MAPS_SENT = 1 << 14      # maps that are broadcast, 64 MB for half a thousand million rows


def numbered(df: DataFrame) -> DataFrame:
    """(carried, row): all columns of `df` in one, and a number for each row. A table that is not read from files as it
    is becomes one first."""
    try:
        place = df.metadataColumn("_metadata")
        found = df.select(packed(df), place["file_path"].alias("file"), place["row_index"].alias("place"))
    except AnalysisException:
        df = written(df.select(packed(df)), "numbered")
        place = df.metadataColumn("_metadata")
        found = df.select("carried", place["file_path"].alias("file"), place["row_index"].alias("place"))
    # One row per file.
    files = found.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("number"))
    files = written(files, "files")
    row = F.shiftleft(F.col("number").cast("long"), FILE_BITS) + F.col("place")
    return found.join(F.broadcast(files), "file").select("carried", row.alias("row"))


def marked(rows: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """`rows` with a flag that says whether their number is in `chosen` (row)."""
    in_map = F.col("row").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    maps = chosen.groupBy(F.shiftright("row", MAP_BITS).alias("map")).agg(F.bitmap_construct_agg(in_map).alias("bits"))
    maps = written(maps, "maps")
    few = F.broadcast(maps) if maps.count() <= MAPS_SENT else maps
    byte = F.substring("bits", F.shiftright(in_map, 3).cast("int") + 1, F.lit(1))
    bits = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.call_function("shiftright", bits, in_map.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    met = rows.withColumn("map", F.shiftright("row", MAP_BITS)).join(few, "map", "left")
    return met.withColumn(name, F.coalesce(bit, F.lit(0)) == 1).drop("map", "bits")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` less those numbered in `gone`."""
    return marked(rows, gone, "goes").where(~F.col("goes")).drop("goes")
