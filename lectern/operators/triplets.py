"""Triplets for the adapter: a tag, a book that has it, and the nearest other tag as hard negative."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.vectors import dot
from lectern.operators.arrow import matrix
from lectern.operators.neighbours import BLOCK_ROWS, PIVOTS, Space, nearest, vectors
from lectern.operators.skew import hot_join, join_checked
from lectern.sources.storage import written

def euclidean() -> Space:
    """Tags as points and as questions; a tag is not a neighbour of itself."""

    def measured(points: pa.Table, asked: pa.Table):
        a, b = vectors(asked, "query_embed"), vectors(points, "tag_embed")
        squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        squared[asked["query_id"].to_numpy()[:, None] == points["id"].to_numpy()[None, :]] = np.inf
        # The expanded form loses digits for close vectors; what comes near the least is measured again.
        least = squared.min(axis=1)
        close = (squared <= (least + 1e-6 * (1 + (a * a).sum(1)))[:, None]) & np.isfinite(squared)
        row, column = np.nonzero(close)
        key = np.sqrt(np.maximum(squared, 0))
        key[row, column] = np.sqrt(((a[row] - b[column]) ** 2).sum(1))
        return key, lambda question, point: []

    return Space(
        lambda rows: vectors(rows, "tag_embed"), lambda rows: vectors(rows, "query_embed"), measured, lambda key: key
    )


def nearest_other(tags: DataFrame, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(id, neg_id, distance): for each tag the nearest other tag by L2 distance; equal distances go by the lower id.

    Blocks of tags meet groups of near tags only where their distances to a pivot do not rule each other out
    (see `neighbours`); a tag without a vector of finite length has no neighbour and is none.
    """
    known = written(
        tags.where(dot(F.col("tag_embed"), F.col("tag_embed")) < float("inf")).select("id", "tag_embed"), "tag-vectors"
    )
    asked = known.select(F.col("id").alias("query_id"), F.col("tag_embed").alias("query_embed"))
    found = nearest(known, asked, euclidean(), 1, block_rows, pivots)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("neg_id"), F.col("key").alias("distance"))


def mine_triplets(tags: DataFrame, bridge: DataFrame, books: DataFrame) -> DataFrame:
    """(tag_id, book_id, neg_id, anchor, pos, neg) for each book-tag pair; `neg` is NULL when there is no other tag.

    The nearest tag is found once per tag, not per pair. The narrow pairs meet the books first, the tag vectors last.
    Tags are read many times, so they are written once.
    """
    tags = written(tags, "tags")
    negatives = nearest_other(tags).select("id", "neg_id")
    vectors = tags.select(F.col("id").alias("neg_id"), F.col("tag_embed").alias("neg"))
    anchors = (
        tags.select("id", F.col("tag_embed").alias("anchor"))
        .join(negatives, "id", "left")
        .join(vectors, "neg_id", "left")
        .withColumnRenamed("id", "tag_id")
    )
    positives = books.select(F.col("id").alias("book_id"), F.col("summary_embed").alias("pos"))
    pairs = hot_join(bridge.select("book_id", "tag_id"), positives, ["book_id"], "inner")
    triplets = join_checked(pairs, anchors, ["tag_id"], sized_by=tags, max_rows=10_000)
    return triplets.select("tag_id", "book_id", "neg_id", "anchor", "pos", "neg")


def evaluate_triplets(triplets: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Cosine distances before and after the adapter; `res` is 1 when the adapted positive is the nearer one."""
    spark = triplets.sparkSession
    shared = spark.sparkContext.broadcast((np.asarray(weights, float), np.asarray(bias, float)))
    keys = [c for c in triplets.columns if c not in ("anchor", "pos", "neg")]
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in triplets.schema.fields if f.name in keys]
        + [f"{c} double" for c in ("distance_pos", "distance_neg", "adapted_distance_pos", "adapted_distance_neg")]
        + ["res int"]
    )

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = shared.value
        for batch in batches:
            parts = [matrix(batch.column(name), w.shape[1]) for name in ("anchor", "pos", "neg")]
            rows = [rows for rows, _ in parts]
            adapted = [part @ w.T + c for part in rows]
            columns = [distance(x[0], x[i]) for x in (rows, adapted) for i in (1, 2)]
            no_pos, no_neg = parts[0][1] | parts[1][1], parts[0][1] | parts[2][1]
            nearer = np.where(no_pos | no_neg, False, columns[2] < columns[3])
            masks = [no_pos, no_neg, no_pos, no_neg]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [pa.array(v, pa.float64(), mask=m) for v, m in zip(columns, masks)]
                + [pa.array(nearer.astype(np.int32), pa.int32())],
                names=[*keys, "distance_pos", "distance_neg", "adapted_distance_pos", "adapted_distance_neg", "res"],
            )

    return triplets.mapInArrow(measure, schema)


def correct_triplets(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("res").count()
