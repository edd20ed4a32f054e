"""Token ids in Parquet files.

Texts are put in order of their ids by a range partitioning, encoded in place, and written as list columns. Ids are
dictionary-encoded, counts and positions delta-encoded; row groups are bounded, pages are small and indexed, so a
reader of some documents or of the counts alone touches few pages. Files are shards in order: a row knows its shard
and its position in it, and the sizes of the shards before give its place among all ids.

Defined results: rows are ordered by id, NULL first, rows of one id by a hash of the text and by the text; a NULL or
empty text has the end id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.arrays import slices
from lectern.llm.data import text_of
from lectern.llm.tokenizer import WordIds
from lectern.sources.storage import shared_dir

END_ID = 1
SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}


def offsets32(counts: np.ndarray) -> pa.Array:
    return pa.array(counts, pa.int32())


def encoded(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID) -> DataFrame:
    """Rows of SCHEMA in shards ordered by id; `start` counts the ids before a row in its shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = WordIds(tokenizer), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = words.encode(part.column(2), end)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(start + counts[:-1]),
                        pa.array(np.diff(counts)),
                        pa.ListArray.from_arrays(offsets32(counts), pa.array(ids, pa.int32())),
                    ],
                    ["shard", "doc_id", "start", "n_tokens", "ids"],
                )
                start += int(counts[-1])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("_key", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key", "text")
    return ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(task, SCHEMA)


def write(df: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID) -> None:
    encoded(df, tokenizer, text, doc_id, end).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): `start` counts all ids of the files before a row."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = rows.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("size"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the only rows that meet in one task.
    before = sizes.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    joined = rows.join(F.broadcast(before), "shard")
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def write_index(spark: SparkSession, path: str) -> None:
    """Beside the files at `path`: one row per file with its first and last id and the ids before it, from metadata columns alone."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    bounds = rows.groupBy(F.col("_metadata.file_name").alias("file"), "shard").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("start") + F.col("n_tokens")).alias("size")
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    bounds.select("file", "first", "last", before.alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}-index")


def read_some(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of `read` with these ids, from the files that the index says may hold them; inside a file, row groups and pages
    without one of the ids are passed over."""
    if not ids:
        return read(spark, path).limit(0)
    index = spark.read.parquet(f"{path}-index")
    covers = [F.col("first").isNotNull() & F.lit(i).between(F.col("first"), F.col("last")) for i in (min(ids), max(ids))]
    wide = index.where(covers[0] | covers[1] | F.col("first").between(min(ids), max(ids))).collect()  # a row per file
    named = [row for row in wide if any(row["first"] <= i <= row["last"] for i in ids)]
    if not named:
        return read(spark, path).limit(0)
    rows = spark.read.schema(SCHEMA).parquet(*(f"{path}/{row['file']}" for row in named)).where(F.col("doc_id").isin(ids))
    before = spark.createDataFrame([(row["file"], row["before"]) for row in named], "file string, before long")
    joined = rows.withColumn("file", F.col("_metadata.file_name")).join(F.broadcast(before), "file")
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(df: DataFrame) -> DataFrame:
    """The `ids` column of `df` replaced by the crc32 of the ids as little-endian 32-bit integers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            starts = [0, *ends[:-1]]
            sums = [zlib.crc32(values[a:b]) for a, b in zip(starts, ends)]
            columns = [*batch.columns[:-1], pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids_crc32"])

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "ids"]
    names = [f.name for f in df.schema if f.name != "ids"]
    return df.select(*names, "ids").mapInArrow(task, ", ".join([*rest, "ids_crc32 long"]))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID) -> DataFrame:
    """Write the ids of all texts and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_dir(df.sparkSession, "token-ids")
    write(df, path, tokenizer, text, doc_id, end)
    return checksums(read(df.sparkSession, path))
