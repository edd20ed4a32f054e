"""Session settings the jobs are designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def get_session(app: str = "lectern", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; `master` is left to spark-submit when absent."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = os.cpu_count() or 1
            digits = "".join(ch for ch in master if ch.isdigit())
            builder = builder.config("spark.sql.shuffle.partitions", digits or str(cores))
            builder = builder.config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **STREAM_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the state store that list state needs, the caller's settings untouched."""
    sibling = spark.newSession()
    for key, value in STREAM_SETTINGS.items():
        sibling.conf.set(key, value)
    # One state store per shuffle partition is opened and committed in every micro-batch.
    sibling.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return sibling


def small_files_session(spark: SparkSession) -> SparkSession:
    """A sibling session that reads thousands of small files in a task, not some thirty, the caller's settings untouched."""
    sibling = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        sibling.conf.set(key, spark.conf.get(key))
    sibling.conf.set("spark.sql.files.openCostInBytes", "64k")
    # Folders are listed by as many tasks as the cluster needs, not by 10,000 that find a few each.
    sibling.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))
    return sibling
