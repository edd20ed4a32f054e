"""Reading tables, logs, sidecars and topics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean_description, xml_description
from lectern.functions.vectors import parse_vector
from lectern.schemas import EVENT


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table; `spread` deals its rows anew where the scan has fewer partitions than the cluster has cores, as a
    table of few large row groups has, which pays before costly work on each row."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if spread and table.rdd.getNumPartitions() < cores else table


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A relational table, read by `partitions` range queries over the integer `column` when one is given.

    The JDBC driver has to be on the class path of the session.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None and bounds is not None:
        reader = reader.options(
            partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Buffered interaction events, one JSON object per line."""
    return spark.read.schema(EVENT).json(path)


def read_triplets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Triplets whose vectors are stored as text."""
    text = spark.read.option("header", True).option("escape", '"').csv(path)
    return text.select(*[parse_vector(F.col(c)).alias(c) for c in ("anchor", "pos", "neg")])


def read_sidecars(spark: SparkSession, base: str, pattern: str = "*.opf") -> DataFrame:
    """One row per catalogue sidecar below `base`: (path, description, summary), the path relative to it."""
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    below = re.sub(r"^[a-z0-9]+:/*", "/", base.rstrip("/"))  # paths come with their scheme, in one spelling or another
    # File paths come URL-encoded, where a plus sign stands for itself.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    located = files.select(
        F.substring_index(decoded, f"{below}/", -1).alias("path"),
        xml_description(F.col("value")).alias("description"),
    )
    return located.withColumn("summary", clean_description(F.col("description")))


def read_prompt_log(spark: SparkSession, path: str) -> DataFrame:
    """(context, query) of each logged prompt; a question may have several lines."""
    return spark.read.schema("context string, query string").option("escape", '"').option("multiLine", True).csv(path)
