"""Model registry: artefacts by type, latest rows, loss curves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.sources.storage import exists

KINDS = ("weights", "optim", "metadata", "losses", "adapter", "adapter_losses")


def save_model(spark: SparkSession, path: str, kind: str, payload: object, model_id: int) -> None:
    """Append one artefact as JSON, stamped with the current time."""
    if kind not in KINDS:
        raise ValueError(f"unknown artefact type {kind!r}")
    row = spark.createDataFrame([(model_id, kind, json.dumps(payload))], "id long, type string, weights string")
    row.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL).parquet(path)


def next_id(spark: SparkSession, path: str) -> int:
    """The id after the largest one stored; 1 where nothing is stored."""
    if not exists(spark, path):
        return 1
    return (read_registry(spark, path).agg(F.max("id")).first()[0] or 0) + 1


def latest_payload(model: DataFrame, kind: str) -> object | None:
    """The newest artefact of a type, None when there is none."""
    row = latest_model(model.where(F.col("type") == kind)).first()
    return None if row is None else json.loads(row["weights"])


def latest_model(model: DataFrame) -> DataFrame:
    """The newest row of each type, the larger id winning a tie; reduced where it is read."""
    newest = F.max_by(F.struct("id", "weights", "timestamp"), F.struct("timestamp", "id")).alias("_row")
    return model.groupBy("type").agg(newest).select("type", "_row.id", "_row.weights", "_row.timestamp")


def last_n_models(model: DataFrame, kind: str | None = None, n: int = 3) -> DataFrame:
    """The newest `n` rows of each type (or of one type), numbered from the newest."""
    rows = model if kind is None else model.where(F.col("type") == kind)
    newest = Window.partitionBy("type").orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("training_round", F.row_number().over(newest)).where(F.col("training_round") <= n)


def loss_curves(model: DataFrame, kind: str = "losses", n: int = 3) -> DataFrame:
    """(training_round, timestamp, epoch, loss) of the last `n` trainings."""
    curves = last_n_models(model, kind, n).withColumn("_losses", F.from_json("weights", "array<double>"))
    return curves.select("training_round", "id", "timestamp", F.posexplode("_losses").alias("epoch", "loss"))


def model_metadata(books: DataFrame) -> DataFrame:
    """Catalogue size and vector length."""
    return books.agg(
        F.max(F.size("summary_embed")).alias("embedding_dim"), F.count(F.lit(1)).alias("action_dim")
    )
