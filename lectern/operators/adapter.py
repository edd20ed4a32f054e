"""The linear adapter: apply it to vectors, fit it on triplets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.arrow import matrix
from lectern.operators.gradients import Adam, clipped, total_gradient, warm_up_then_decay
from lectern.schemas import VECTOR
from lectern.sources.storage import shared_dir


def apply_adapter(df: DataFrame, col: str, weights: np.ndarray, bias: np.ndarray, out: str) -> DataFrame:
    """`weights @ vector + bias` for each vector of `col`; NULL stays NULL."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(weights, float), np.asarray(bias, float)))

    @F.pandas_udf(VECTOR)
    def adapted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        for series in batches:
            present = [vector for vector in series if vector is not None]
            rows = np.stack(present).astype(np.float64) if present else np.empty((0, w.shape[1]))
            adapted_rows = iter((rows @ w.T + b).astype(np.float32))
            yield pd.Series([None if vector is None else next(adapted_rows) for vector in series], dtype=object)

    return df.withColumn(out, adapted(F.col(col)))


def triplet_loss(
    parameters: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], margin: float
) -> tuple[float, np.ndarray]:
    """Summed cosine triplet loss of (anchor, pos, neg) rows and its gradient; the last parameter column is the bias."""
    w, b = parameters[:, :-1], parameters[:, -1]
    anchor, pos, neg = (part @ w.T + b for part in rows)

    def cosine(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine per row, and its derivatives by u and by v."""
        nu = np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-8)
        nv = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        c = (u * v).sum(1, keepdims=True) / (nu * nv)
        return c[:, 0], v / (nu * nv) - c * u / nu**2, u / (nu * nv) - c * v / nv**2

    near, near_a, near_p = cosine(anchor, pos)
    far, far_a, far_n = cosine(anchor, neg)
    loss = np.maximum(0.0, far - near + margin)
    active = (loss > 0)[:, None]
    slopes = [(far_a - near_a) * active, -near_p * active, far_n * active]
    gradient = np.hstack(
        [
            sum(slope.T @ part for slope, part in zip(slopes, rows)),
            sum(slope.sum(0) for slope in slopes)[:, None],
        ]
    )
    return float(loss.sum()), gradient


def fit_adapter(
    triplets: DataFrame,
    output_dim: int = 128,
    epochs: int = 30,
    steps_per_epoch: int = 8,
    learning_rate: float = 0.005,
    warm_up: int = 100,
    max_norm: float = 1.0,
    margin: float = 1.0,
    seed: int = 42,
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights, bias and mean loss per epoch of a cosine-triplet fit.

    Triplets are written once, in `steps_per_epoch` parts; a step sums the gradient of one part over the cluster, so
    the parts take the place of mini-batches. Only parameters and gradients pass the driver.
    """
    spark = triplets.sparkSession
    complete = triplets.select("anchor", "pos", "neg").where(
        F.col("anchor").isNotNull() & F.col("pos").isNotNull() & F.col("neg").isNotNull()
    )
    path = shared_dir(spark, "triplets")
    part = F.pmod(F.xxhash64("anchor", "pos", "neg"), F.lit(steps_per_epoch))
    complete.withColumn("part", part).write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    sizes = {row["part"]: row["count"] for row in stored.groupBy("part").count().collect()}
    if not sizes:
        raise ValueError("no triplet has all three vectors")
    input_dim = stored.select(F.size("anchor").alias("n")).first()["n"]

    limit = 1 / np.sqrt(input_dim)
    parameters = np.random.default_rng(seed).uniform(-limit, limit, (output_dim, input_dim + 1))
    optimiser = Adam(decay=0.01)
    losses, step = [], 0
    for _ in range(epochs):
        epoch_loss = 0.0
        for number in sorted(sizes):
            shared = spark.sparkContext.broadcast(parameters)

            def add_batch(batch: pa.RecordBatch, shared=shared) -> tuple[float, np.ndarray]:
                rows = tuple(matrix(batch.column(name), input_dim)[0] for name in ("anchor", "pos", "neg"))
                loss, gradient = triplet_loss(shared.value, rows, margin)
                return loss, gradient.ravel()

            rows = stored.where(F.col("part") == number).select("anchor", "pos", "neg")
            loss, gradient = total_gradient(rows, add_batch, parameters.size)
            change = clipped(gradient / sizes[number], max_norm).reshape(parameters.shape)
            rate = learning_rate * warm_up_then_decay(step, warm_up, epochs * len(sizes))
            parameters = optimiser.step(parameters, change, rate)
            epoch_loss += loss / sizes[number]
            step += 1
            shared.unpersist()
        losses.append(epoch_loss / len(sizes))
    return parameters[:, :-1], parameters[:, -1], losses
