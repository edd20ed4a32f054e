"""The exact nearest points of a table of questions, with most blocks of points never sent to most questions.

A bounded number of points are pivots. Every point belongs to the cell of its nearest pivot; cells that are large are cut
into rings by the distance to the pivot, rings that are still large into pieces by a hash of the id, so that a block has at
most about `block_rows` points whatever repeats. The triangle inequality bounds the distance of a question to all points of a ring
from below by the pivot's distance and the ring's two radii.

The nearest points come in two rounds. First a question meets the rings of least bound that hold enough points; its k-th
distance there is the mark. Then it meets only the other rings whose bound does not exceed the mark. Questions are dealt
in groups of near ones, so a block of points is sent once for each group that needs it and to no other. The
driver sees the pivots and one row per ring, both bounded by parameters; neither points nor questions pass it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.operators.arrow import first_per_group
from lectern.operators.skew import fits
from lectern.sources.storage import written

BLOCK_ROWS = 4_096       # points of a block, and questions of a group
PIVOTS = 1_024
RINGS = 64               # rings of a cell at most
CELLS_PER_STEP = 4_000_000
MARGIN = 1e-6            # what rounding may add to a distance

Vectors = Callable[[pa.RecordBatch | pa.Table], np.ndarray]


@dataclass(frozen=True)
class Space:
    """How rows become vectors, and how a block of points is measured against a group of questions.

    `measured(points, questions)` gives the keys, questions x points, that decide the order (inf: not a neighbour) and
    the extra numbers of chosen (question, point) pairs, named by `columns`; `distance(key)` is the Euclidean distance
    between the vectors of such a pair, as a column.
    """

    points: Vectors
    questions: Vectors
    measured: Callable[[pa.Table, pa.Table], tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], list[np.ndarray]]]]
    distance: Callable[[Column], Column]
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rings:
    """Rings of all cells: cell, pieces, points and least and largest distance to the pivot, by ring."""

    pivots: np.ndarray
    cell: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors to the points of every ring, vectors x rings."""
        to_pivot = _distances(rows, self.pivots)[:, self.cell]
        return np.maximum(np.maximum(to_pivot - self.most, self.least - to_pivot), 0.0)


def vectors(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A list column without NULLs as rows of doubles."""
    column = rows.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _chosen_pivots(points: DataFrame, vectors: Vectors, number: int) -> np.ndarray:
    """Vectors of `number` points in the order of a hash: the same ones in every run."""
    return vectors(points.orderBy(F.xxhash64("id"), "id").limit(number).toArrow())


def _in_cells(rows: DataFrame, vectors: Vectors, pivots: np.ndarray) -> DataFrame:
    """Rows with the cell of the nearest pivot and the distance to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch)
            cell = np.empty(len(found), np.int32)
            step = max(CELLS_PER_STEP // len(pivots), 1)
            for k in range(0, len(found), step):
                cell[k : k + step] = _distances(found[k : k + step], pivots).argmin(axis=1)
            radius = np.linalg.norm(found - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(radius)], [*batch.schema.names, "cell", "radius"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    return rows.mapInArrow(task, schema)


def _in_rings(placed: DataFrame, pivots: np.ndarray, block_rows: int) -> tuple[DataFrame, Rings, DataFrame]:
    """Points with their ring and piece, the rings, and (ring, pieces) as a table."""
    spark = placed.sparkSession
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    parts = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows)).cast("int")
    # One row per pivot.
    cells = spark.createDataFrame(cells.select("cell", "low", "high", parts.alias("parts")).collect(), "cell int, low double, high double, parts int")
    place = F.floor((F.col("radius") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts"))
    ring = F.when((F.col("parts") == 1) | (F.col("high") == F.col("low")), 0).otherwise(F.least(place, F.col("parts") - 1))
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", F.col("cell") * RINGS + ring.cast("int"))
    found = (
        ringed.groupBy("ring")
        .agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        .orderBy("ring").collect()  # at most PIVOTS x RINGS rows
    )
    names = np.array([row["ring"] for row in found], np.int64)
    rings = Rings(pivots, names // RINGS, *(np.array([row[c] for row in found], float) for c in ("n", "low", "high")))
    pieces = spark.createDataFrame(
        [(int(name), i, int(-(-row["n"] // block_rows))) for i, (name, row) in enumerate(zip(names, found))],
        "ring int, place int, pieces int",
    )
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
    kept = [c for c in placed.columns if c not in ("cell", "radius")]
    held = ringed.join(F.broadcast(pieces), "ring").select(*kept, F.col("place").alias("ring"), piece)
    return held, rings, pieces.select(F.col("place").alias("ring"), "pieces")


def _asking(questions: DataFrame, space: Space, rings: Rings, k: int, marked: bool) -> DataFrame:
    """Questions with the rings they meet: those of least bound with more than `k` points, or, `marked`, the other ones
    that the mark does not rule out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = space.questions(batch)
            step = max(CELLS_PER_STEP // len(rings.cell), 1)
            sizes, found = [], []
            for a in range(0, len(rows), step):
                bound = rings.bounds(rows[a : a + step])
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(rings.count[order], axis=1) - rings.count[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before <= k, axis=1)
                if marked:
                    mark = batch.column("mark").slice(a, step).fill_null(np.inf).to_numpy(zero_copy_only=False)
                    first = ~first & (bound <= mark[:, None] * (1 + MARGIN) + MARGIN)
                sizes.append(first.sum(axis=1))
                found.append(np.nonzero(first)[1])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            values = pa.array(np.concatenate(found) if found else [], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, lists], [*names, "rings"])

    names = [c for c in questions.columns if c != "mark"]
    fields = [questions.schema[c] for c in names]
    return questions.mapInArrow(task, T.StructType([*fields, T.StructField("rings", T.ArrayType(T.IntegerType()))]))


def _grouped(questions: DataFrame, group_rows: int) -> DataFrame:
    """Questions (with their cell) in groups of near ones, at most about `group_rows` each."""
    sizes = questions.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per pivot
    if sum(row["n"] for row in sizes) <= group_rows:
        return questions.withColumn("part", F.lit(0).cast("long")).drop("cell", "radius")
    parts = questions.sparkSession.createDataFrame(
        [(row["cell"], int(-(-row["n"] // group_rows))) for row in sizes], "cell int, parts int"
    )
    piece = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    joined = questions.join(F.broadcast(parts), "cell")
    return joined.withColumn("part", F.col("cell").cast("long") * 2**32 + piece).drop("cell", "radius", "parts")


def _met(asking: DataFrame, held: DataFrame, pieces: DataFrame, space: Space, k: int, schema: T.StructType) -> DataFrame:
    """The best `k` points of each block for every question that meets it."""
    # The lists are read twice: which groups need a block, and the questions themselves.
    asking = written(asking.where(F.size("rings") > 0), "asking")
    each = asking.select("*", F.explode("rings").alias("ring")).drop("rings").join(F.broadcast(pieces), "ring")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    wanted = asking.select("part", F.explode("rings").alias("ring")).distinct().toDF("part", "ring")
    needed = held.join(F.broadcast(wanted) if fits(wanted) else wanted, "ring")
    keys = ["ring", "piece", "part"]

    def block(points: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = []
        points, asked = points.combine_chunks(), asked.combine_chunks()
        step = max(CELLS_PER_STEP // max(points.num_rows, 1), 1)
        ids = points["id"].to_numpy()
        for a in range(0, asked.num_rows if points.num_rows else 0, step):
            some = asked.slice(a, step)
            key, extra = space.measured(points, some)
            if len(ids) > k:
                worst = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
                question, point = np.nonzero((key <= worst) & (key < np.inf))
            else:
                question, point = np.nonzero(key < np.inf)
            best = first_per_group(question, key[question, point], ids[point], k)
            question, point = question[best], point[best]
            rows.append([question + a, point, key[question, point], *extra(question, point)])
        if not rows:
            rows = [[np.empty(0, np.int64), np.empty(0, np.int64), *np.empty((1 + len(space.columns), 0))]]
        question, point, *numbers = (np.concatenate(x) for x in zip(*rows))
        out = [asked["query_id"].take(pa.array(question)), points["id"].take(pa.array(point)), *map(pa.array, numbers)]
        return pa.table(dict(zip(["query_id", "id", "key", *space.columns], out)))

    return needed.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(block, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("key", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    points: DataFrame, questions: DataFrame, space: Space, k: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, id, key, ..., rank): the `k` points (id, ...) of least key for each question (query_id, ...).

    `points` is read several times and should be a written table. All vectors have to be finite.
    """
    schema = T.StructType().add("query_id", questions.schema["query_id"].dataType).add("id", points.schema["id"].dataType)
    for name in ("key", *space.columns):
        schema = schema.add(name, "double")
    number = min(pivots, -(-points.count() // block_rows))
    if number == 0:
        return points.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if number == 1:  # all points are one block
        spark = points.sparkSession
        one = spark.createDataFrame([(0, 1)], "ring int, pieces int")
        held = points.withColumns({"ring": F.lit(0), "piece": F.lit(0)})
        groups = -(-questions.count() // block_rows)
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(groups, 1)))
        asking = questions.withColumns({"part": part, "rings": F.array(F.lit(0))})
        return _first(_met(asking, held, one, space, k, schema), k)
    chosen = _chosen_pivots(points, space.points, number)
    placed = written(_in_cells(points, space.points, chosen), "placed-points")
    held, rings, pieces = _in_rings(placed, chosen, block_rows)
    asked = written(_grouped(written(_in_cells(questions, space.questions, chosen), "placed-questions"), block_rows), "questions")
    opened = written(_met(_asking(asked, space, rings, k, False), held, pieces, space, k, schema), "opened-rings")
    last = _first(opened, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.max("key").alias("key"))
    enough = space.distance(F.col("key"))
    marks = last.select("query_id", F.when(F.col("found") == k, enough).alias("mark"))
    marked = asked.join(F.broadcast(marks) if fits(marks) else marks, "query_id", "left")
    rest = _met(_asking(marked, space, rings, k, True), held, pieces, space, k, schema)
    return _first(opened.unionByName(rest), k)
