"""Folders shared by the whole cluster, and tables written to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_notes: list[list[str]] = []  # of those who want to know what is staged


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that get a name while this is open, for whoever removes them once nothing reads them any more."""
    folders: list[str] = []
    _notes.append(folders)
    try:
        yield folders
    finally:
        _notes.remove(folders)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder the cluster names in `spark.checkpoint.dir`, or else below the warehouse.

    Both are places every executor reaches; a machine-local temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _notes:
        folders.append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so a lost executor re-reads instead of re-computing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder written under `shared_dir` once nothing reads it any more."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [status.getPath().getName() for status in jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm)]
