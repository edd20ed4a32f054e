"""Writing tables, logs, topics and model rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.actions import epoch_date
from lectern.functions.vectors import to_json_vector


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_facts(facts: DataFrame, path: str) -> None:
    """Append facts in folders by month of their instant, which dated reads prune.

    Rows are rebalanced by month: small months share a task, and a large one is split over many.
    """
    dated = facts.withColumn("month", F.date_format(epoch_date(F.unix_seconds("created_at")), "yyyy-MM"))
    append(dated.hint("rebalance", F.col("month")), path, ["month"])


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a whole table as a new version next to the one being read; returns its folder.

    The version counts once it is listed, which happens after all of its files are there.
    """
    root = root.rstrip("/")
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    listed = df.sparkSession.createDataFrame([(version,)], "version int")
    listed.write.mode("append").parquet(f"{root}-versions")
    return path


def current_version(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The newest listed version of a table, and its number."""
    root = root.rstrip("/")
    newest = spark.read.schema("version int").parquet(f"{root}-versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={newest}"), newest


def write_texts(texts: DataFrame, folder: str, key: str) -> None:
    """(`key`, a whole number, and text) as a file for each key, in a folder named by it; texts of one key are lines of its file.

    In a mounted folder tasks write files themselves, with the names and lines of Spark's text writer: without Hadoop's native
    library that one starts a process for the permissions of each file. Other file systems are left to it.
    """
    dealt = texts.repartition(key)
    if re.match("[a-z0-9]+:", folder) and not folder.startswith("file:"):
        # Tasks move their files to their places themselves: the driver would move all of them one by one.
        writer = dealt.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.text(folder)
        return
    base = re.sub("^file:/*", "/", folder.rstrip("/"))
    os.makedirs(base, exist_ok=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        count = 0
        for number, same in groupby(rows, key=lambda row: row[0]):
            place = f"{base}/{key}={'__HIVE_DEFAULT_PARTITION__' if number is None else number}"
            os.makedirs(place, exist_ok=True)
            part = f"{place}/.part-{os.getpid()}"
            with open(part, "wb") as file:
                file.writelines((text or "").encode() + b"\n" for _, text in same)
            os.replace(part, f"{place}/part-0.txt")  # done again, a task leaves the same files
            count += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    text = next(name for name in texts.columns if name != key)
    ordered = dealt.select(key, text).sortWithinPartitions(key)
    ordered.mapInArrow(task, "files long").write.format("noop").mode("overwrite").save()


def event_messages(events: DataFrame) -> DataFrame:
    """Key (session) and JSON value of each event, as a topic takes them."""
    fields = ["sid", "uid", "bid", "action", "timestamp"]
    return events.select(
        F.col("sid").cast("string").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
    )


def publish(events: DataFrame, servers: str, topic: str = "UserInteraction") -> None:
    event_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def write_triplets_csv(triplets: DataFrame, path: str) -> None:
    text = triplets.select(*[to_json_vector(F.col(c)).alias(c) for c in ("anchor", "pos", "neg")])
    text.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_prompt_log(contexts: DataFrame, path: str) -> None:
    """Append the context and the question of each prompt."""
    contexts.select("context", "query").write.mode("append").option("escape", '"').csv(path)
