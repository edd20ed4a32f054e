"""Nearest points through pivots against all distances, and blocks that are not sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import neighbours, retrieval, triplets


def clustered(n, dim=6, seed=1, repeated=0.3):
    """Points around a few centres; a third of all are the same point."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(0, 1, (20, dim))
    points = (centres[rng.integers(0, 20, n)] + rng.normal(0, 0.1, (n, dim))).round(2)
    points[: int(repeated * n)] = points[0]
    return points.astype(np.float32).astype(float)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    title, summary = clustered(1500), clustered(1500, seed=2)
    rows = [(i, t.tolist(), s.tolist()) for i, (t, s) in enumerate(zip(title, summary))]
    return title, summary, spark.createDataFrame(rows, "id int, title_embed array<float>, summary_embed array<float>").repartition(4)


@pytest.mark.parametrize("block_rows, pivots", [(4096, 1024), (80, 1024), (80, 3), (30, 50)])
def test_dense_top_equals_all_distances(spark, table, block_rows, pivots):
    title, summary, books = table
    asked = np.vstack([clustered(60, seed=3, repeated=0.5), title[:3], 100 * title[700:703]])
    questions = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, query_embed array<float>")
    asked = asked.astype(np.float32).astype(float)
    key = np.round(0.5 * (1 - unit(asked) @ unit(title).T) + 0.75 * (1 - unit(asked) @ unit(summary).T), 12)
    found = {}
    for row in retrieval.dense_top(questions, books, 10, block_rows, pivots).orderBy("query_id", "dense_rank").collect():
        found.setdefault(row["query_id"], []).append((row["id"], row["combined_similarity"]))
    for i in range(len(asked)):
        best = np.lexsort((np.arange(len(title)), key[i]))[:10]
        assert [p for p, _ in found[i]] == best.tolist()
        assert [d for _, d in found[i]] == pytest.approx(key[i, best].tolist(), abs=1e-9)


@pytest.mark.parametrize("block_rows, pivots", [(4096, 1024), (60, 1024), (60, 2)])
def test_nearest_other_equals_all_distances(spark, block_rows, pivots):
    points = clustered(700, seed=5)
    tags = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, tag_embed array<float>").repartition(3)
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(distance, np.inf)
    found = triplets.nearest_other(tags, block_rows, pivots).collect()
    assert len(found) == 700
    for row in found:
        assert row["neg_id"] == distance[row["id"]].argmin() and row["distance"] == pytest.approx(distance[row["id"]].min(), abs=1e-9)


def test_bounds_hold_and_rule_rings_out(spark, table):
    title, summary, books = table
    space = retrieval.weighted_cosine()
    points = books.withColumn("kind", F.lit(0))
    pivots = neighbours._chosen_pivots(points, space.points, 12)
    held, rings, pieces = neighbours._in_rings(neighbours._in_cells(books, space.points, pivots), pivots, 80)
    rows = held.select("id", "ring", "piece").collect()
    assert sorted(r["id"] for r in rows) == list(range(1500))
    sizes = {}
    for r in rows:
        sizes[r["ring"], r["piece"]] = sizes.get((r["ring"], r["piece"]), 0) + 1
    assert max(sizes.values()) < 160  # repeated points are cut by a hash of their ids
    own = np.hstack([0.5 * unit(title), np.sqrt(0.375) * unit(summary)])
    bound, apart = rings.bounds(own[::50]), neighbours._distances(own[::50], own)
    ring = np.array([r["ring"] for r in sorted(rows, key=lambda r: r["id"])])
    assert (bound[:, ring] <= apart + 1e-6).all()
    mark = np.sort(apart, axis=1)[:, 10]
    assert (bound <= mark[:, None]).mean() < 0.6  # many (question, ring) pairs never meet


def test_no_neighbour_for_a_single_tag(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, tag_embed array<float>")
    assert triplets.nearest_other(one).count() == 0
    assert triplets.nearest_other(one.where("false")).count() == 0
