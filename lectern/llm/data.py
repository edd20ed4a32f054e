"""What the operators of this subpackage share: tables, folds and the values of columns that may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT = 2
FOLDS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, NULL as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4; an id that is NULL counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (crc % FOLDS) == HELD_OUT


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, name: str = "carried") -> Column:
    """All columns of `df` in one, so that none of them can clash with what an operator adds; `carried.*` unpacks."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)
