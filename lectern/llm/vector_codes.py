"""Vectors as codes of their parts: a codebook per part position, fitted by exact integer rounds over metric trees.

Vectors become integers, floor(256 x) each, and are packed into blocks. For each part position a block keeps a metric tree
made middle-out by an anchors hierarchy: about sqrt(n) anchors, each new one the point furthest from its own, take points
from the others where the triangle inequality lets them; anchors are joined upwards, the two with the least common ball
first, and divided downwards in the same way. Every ball caches count and sum of its points. A round walks the
trees from the top with the list of all entries: an entry that is further than another from every point of a ball
leaves the list that its children inherit; a ball with one entry left is wholly owned and gives its cached sum; in leaves
the distances to the entries left are taken, in whole numbers. Sums meet over the cluster by (part, entry); the driver sees the
codebooks, parts x entries rows. Trees are written once and read by every round.

Defined results: rows whose vector is NULL, empty, or holds NULL, NaN or infinite components go. The length of vectors is that of the
smallest vec_id whose length parts divides; vectors of another length have neither code nor error. Rows that repeat, and
rows without vec_id (which come last), are vectors of their own; equal vec_ids are ordered by their vectors. With
fewer vectors than entries the codebooks are shorter. Components are held within 2^62, errors within the largest long.
Blocks that hold numbers too large for 64-bit distances are one leaf each and reckon with unbounded integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import releasing
from lectern.operators.skew import join_checked
from lectern.sources.storage import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
BLOCK_NUMBERS = 1 << 19   # numbers of a block
LEAF = 16                 # points of a ball that is not divided
DEPTH = 12                # divisions at most; a leaf is right at any size
HELD = 1 << 62
LOW = (1 << 32) - 1


def safe_limit(width: int) -> int:
    """The magnitude below which squared distances of `width` numbers fit in 62 bits."""
    return int((2.0**62 / width) ** 0.5 / 2) - 1


@dataclass
class Tree:
    """Balls, the root first; `left` is -1 for a leaf, whose points are at begin .. end. `order` are the points' rows."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    total: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    FIELDS = (
        ("points", "i8"), ("order", "i4"), ("center", "f8"), ("radius", "f8"), ("count", "i8"),
        ("total", "i8"), ("left", "i4"), ("right", "i4"), ("begin", "i4"), ("end", "i4"),
    )

    def packed(self) -> bytes:
        """Points as 32-bit numbers where they fit, then one field after the other."""
        n, width, balls = *self.points.shape, len(self.radius)
        small = n == 0 or int(np.abs(self.points).max()) < 2**31
        out = [np.array([n, width, balls, small], "i8").tobytes()]
        for name, kind in self.FIELDS:
            out.append(getattr(self, name).astype("i4" if name == "points" and small else kind).tobytes())
        return b"".join(out)

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        n, width, balls, small = np.frombuffer(raw, "i8", 4).tolist()
        shapes = {"points": (n, width), "order": (n,), "center": (balls, width), "total": (balls, width)}
        found, at = {}, 32
        for name, kind in cls.FIELDS:
            shape = shapes.get(name, (balls,))
            kind = np.dtype("i4" if name == "points" and small else kind)
            size = int(np.prod(shape))
            found[name] = np.frombuffer(raw, kind, size, at).reshape(shape)
            at += size * kind.itemsize
        found["points"] = found["points"].astype(np.int64)
        return cls(**found)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...i,...i->...", x, x))


def anchored(points: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The anchor that owns each point. Groups of points begin at `starts`; a group gets up to `wanted` anchors."""
    sizes = np.diff(np.append(starts, len(points)))
    group = np.repeat(np.arange(len(starts)), sizes)
    places = np.zeros((len(starts), int(wanted.max()), points.shape[1]))
    places[:, 0] = points[starts]
    owner = np.zeros(len(points), np.int64)
    distance = lengths(points - places[group, 0])
    for j in range(1, int(wanted.max())):
        furthest = np.maximum.reduceat(distance, starts)
        goes_on = (j < wanted) & (furthest > 0)
        if not goes_on.any():
            break
        at = np.flatnonzero(distance == furthest[group])
        at = at[np.unique(group[at], return_index=True)[1]]  # the first of each group
        places[:, j] = points[at]
        between = lengths(places[:, :j] - places[:, j, None])
        # A point nearer to its anchor than half the way to the new one stays, without a look at its distance.
        asked = np.flatnonzero(goes_on[group] & (2 * distance > between[group, owner]))
        new = lengths(points[asked] - places[group[asked], j])
        won = new < distance[asked]
        owner[asked[won]], distance[asked[won]] = j, new[won]
    return owner


class Balls:
    """Balls of a tree that is being made."""

    def __init__(self, width: int):
        self.rows: dict[str, list[np.ndarray]] = {name: [] for name, _ in Tree.FIELDS[2:]}
        self.n, self.width = 0, width

    def add(self, **columns: np.ndarray) -> np.ndarray:
        size = len(columns["radius"])
        for name, rows in self.rows.items():
            rows.append(columns.get(name, np.full(size, -1)))
        self.n += size
        return np.arange(self.n - size, self.n)

    def column(self, name: str) -> np.ndarray:
        self.rows[name] = [np.concatenate(self.rows[name])]
        return self.rows[name][0]


def joined(balls: Balls, first: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Join the balls `first` of each group upwards, the pair with the least common ball first; the top of each group."""
    counts = np.bincount(group, minlength=groups)
    most = int(counts.max())
    place = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids = np.full((groups, most), -1)
    ids[group, place] = first
    alive = ids >= 0
    count, radius = np.zeros((groups, most), np.int64), np.zeros((groups, most))
    center, total = np.zeros((groups, most, balls.width)), np.zeros((groups, most, balls.width), np.int64)
    for held, name in ((count, "count"), (radius, "radius"), (center, "center"), (total, "total")):
        held[group, place] = balls.column(name)[first]

    def common(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(ra, rb), (lengths(a - b) + ra + rb) / 2)

    cost = common(center[:, :, None], radius[:, :, None], center[:, None], radius[:, None])
    cost[~(alive[:, :, None] & alive[:, None])] = np.inf
    cost[:, np.arange(most), np.arange(most)] = np.inf
    while (live := np.flatnonzero(alive.sum(axis=1) > 1)).size:
        best = cost[live].reshape(len(live), -1).argmin(axis=1)
        i, j = np.minimum(best // most, best % most), np.maximum(best // most, best % most)
        count_, total_ = count[live, i] + count[live, j], total[live, i] + total[live, j]
        center_ = total_ / count_[:, None]
        radius_ = np.maximum(
            lengths(center_ - center[live, i]) + radius[live, i], lengths(center_ - center[live, j]) + radius[live, j]
        )
        made = balls.add(
            center=center_, radius=radius_, count=count_, total=total_, left=ids[live, i], right=ids[live, j]
        )
        ids[live, i], count[live, i], total[live, i] = made, count_, total_
        center[live, i], radius[live, i] = center_, radius_
        alive[live, j] = False
        cost[live, j], cost[live, :, j] = np.inf, np.inf
        row = common(center[live], radius[live], center_[:, None], radius_[:, None])
        row[~alive[live]] = np.inf
        row[np.arange(len(live)), i] = np.inf
        cost[live, i], cost[live, :, i] = row, row
    return ids[np.arange(groups), alive.argmax(axis=1)]


def exact_balls(points: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Count, sum, mean and radius of consecutive groups of points."""
    count = np.diff(np.append(starts, len(points)))
    total = np.add.reduceat(points, starts, axis=0)
    center = total / count[:, None]
    radius = np.maximum.reduceat(lengths(points - np.repeat(center, count, axis=0)), starts)
    return {"count": count, "total": total, "center": center, "radius": radius * (1 + 1e-9)}


def grown(points: np.ndarray, leaf: int = LEAF, depth: int = DEPTH) -> Tree:
    """The tree of the rows of `points`, middle-out."""
    n, width = points.shape
    order = np.arange(n)
    balls = Balls(width)
    top = balls.add(**exact_balls(points, np.zeros(1, np.int64)), begin=np.array([0]), end=np.array([n]))
    open_, begins, ends = top, np.array([0]), np.array([n])
    for _ in range(depth):
        wide = (ends - begins > leaf) & (balls.column("radius")[open_] > 0)
        open_, begins, ends = open_[wide], begins[wide], ends[wide]
        if not len(open_):
            break
        sizes = ends - begins
        starts = np.cumsum(sizes) - sizes
        where = np.repeat(begins - starts, sizes) + np.arange(sizes.sum())
        some = points[order[where]]
        group = np.repeat(np.arange(len(open_)), sizes)
        owner = anchored(some.astype(np.float64), starts, np.ceil(np.sqrt(sizes)).astype(np.int64))
        moved = np.lexsort((owner, group))
        order[where] = order[where[moved]]
        some, owner, group = some[moved], owner[moved], group[moved]
        edge = np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]))
        firsts = np.flatnonzero(edge)
        begin, count = where[firsts], np.diff(np.append(firsts, len(some)))
        made = balls.add(**exact_balls(some, firsts), begin=begin, end=begin + count)
        tops = joined(balls, made, group[firsts], len(open_))
        # The ball that was divided keeps its own, tighter measure and takes the children of the top of its anchors.
        for name in ("left", "right"):
            balls.column(name)[open_] = balls.column(name)[tops]
        open_, begins, ends = made, begin, begin + count
    return Tree(points[order], order, **{name: balls.column(name) for name, _ in Tree.FIELDS[2:]})


def single_leaf(points: np.ndarray) -> Tree:
    """All points in one ball, for numbers whose sums and distances 64 bits do not hold."""
    n, width = points.shape
    one = np.zeros(1, np.int64)
    return Tree(points, np.arange(n), np.zeros((1, width)), np.full(1, np.inf), one + n, np.zeros((1, width), np.int64), one - 1, one - 1, one, one + n)


def nearest(points: np.ndarray, of: np.ndarray, lists: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point among those its list allows, the lower index on ties, and the squared distance.

    `lists` has a row of flags per list; `of` names the list of each point. Whole numbers throughout.
    """
    listed, allowed = np.nonzero(lists)
    sizes = np.bincount(listed, minlength=len(lists))
    begin = np.cumsum(sizes) - sizes
    code = np.empty(len(points), np.int64)
    error = np.empty(len(points), entries.dtype)
    step = max(BLOCK_NUMBERS // max(int(sizes.max(initial=1)), 1), 1)
    for a in range(0, len(points), step):
        own = of[a : a + step]
        each = sizes[own]
        first = np.cumsum(each) - each
        entry = allowed[np.repeat(begin[own] - first, each) + np.arange(each.sum())]
        apart = np.repeat(points[a : a + step], each, axis=0) - entries[entry]
        distance = (apart * apart).sum(axis=1)
        least = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == np.repeat(least, each))
        point = np.repeat(np.arange(len(own)), each)[hits]
        hits = hits[np.unique(point, return_index=True)[1]]
        code[a : a + step], error[a : a + step] = entry[hits], least
    return code, error


class Walk:
    """A walk through one tree with the entries of its part position."""

    def __init__(self, tree: Tree, entries: np.ndarray):
        self.tree, self.entries = tree, entries
        self.near = entries.astype(np.float64)

    def lists(self, balls: np.ndarray, inherited: np.ndarray) -> np.ndarray:
        """What is left of the inherited lists: an entry goes if another is nearer to every point of the ball."""
        distance = lengths(self.tree.center[balls][:, None] - self.near[None])
        best = np.where(inherited, distance, np.inf).min(axis=1)
        radius = self.tree.radius[balls]
        bound = best + 2 * radius
        return inherited & (distance <= (bound + 1e-9 * (bound + distance.max(axis=1)) + 1e-6)[:, None])

    def levels(self, stop_at_owned: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(wholly owned balls, their entries, leaves, their lists) from the top down."""
        balls, lists = np.zeros(1, np.int64), np.ones((1, len(self.entries)), bool)
        while len(balls):
            lists = self.lists(balls, lists)
            owned = (lists.sum(axis=1) == 1) & stop_at_owned
            leaf = (self.tree.left[balls] < 0) & ~owned
            yield balls[owned], lists[owned].argmax(axis=1), balls[leaf], lists[leaf]
            rest = ~(owned | leaf)
            balls = np.concatenate([self.tree.left[balls[rest]], self.tree.right[balls[rest]]])
            lists = np.concatenate([lists[rest], lists[rest]])

    def in_leaves(self, leaves: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, entry, squared distance) of all points of the leaves."""
        sizes = self.tree.end[leaves] - self.tree.begin[leaves]
        first = np.cumsum(sizes) - sizes
        place = np.repeat(self.tree.begin[leaves] - first, sizes) + np.arange(sizes.sum())
        points = self.tree.points[place].astype(self.entries.dtype)
        return place, *nearest(points, np.repeat(np.arange(len(leaves)), sizes), lists, self.entries)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """How many points each entry owns, and the sum of them."""
        count = np.zeros(len(self.entries), np.int64)
        total = np.zeros(self.entries.shape, self.entries.dtype)
        for owned, entry, leaves, lists in self.levels(True):
            np.add.at(count, entry, self.tree.count[owned])
            np.add.at(total, entry, self.tree.total[owned].astype(total.dtype))
            if len(leaves):
                place, code, _ = self.in_leaves(leaves, lists)
                np.add.at(count, code, 1)
                np.add.at(total, code, self.tree.points[place].astype(total.dtype))
        return count, total

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row of the block."""
        n = len(self.tree.points)
        code, error = np.zeros(n, np.int64), np.zeros(n, self.entries.dtype)
        for _, _, leaves, lists in self.levels(False):
            if len(leaves):
                place, found, apart = self.in_leaves(leaves, lists)
                code[self.tree.order[place]], error[self.tree.order[place]] = found, apart
        return code, error


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """Components of the vectors of a list column as whole numbers, rows x width."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        floors = np.floor(SCALE * values)
    return np.clip(floors, -HELD, HELD).astype(np.int64)


def blocks(vectors: DataFrame, width: int, parts: int, label_type: str) -> DataFrame:
    """Rows of (vec_ids, labels, trees): a block of vectors with a tree for each part position."""
    most = max(BLOCK_NUMBERS // width, 1)
    step = width // parts
    limit = safe_limit(step)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, schema = [], 0, None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                whole = pa.Table.from_batches(held).combine_chunks()
                for a in range(0, n - most + 1, most):
                    yield block(whole.slice(a, most))
                rest = whole.slice(n // most * most)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield block(pa.Table.from_batches(held, schema).combine_chunks())

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        numbers = scaled(rows["vector"].combine_chunks(), width)
        narrow = int(np.abs(numbers).max()) < limit
        trees = [(grown if narrow else single_leaf)(numbers[:, p * step : (p + 1) * step]).packed() for p in range(parts)]

        def one(column: pa.ChunkedArray) -> pa.Array:
            flat = column.combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

        columns = [one(rows["vec_id"]), one(rows["label"]), pa.array([trees], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["vec_ids", "labels", "trees"])

    schema = f"vec_ids array<bigint>, labels array<{label_type}>, trees array<binary>"
    return vectors.select("vec_id", "label", "vector").mapInArrow(releasing(task), schema)


def walks(trees: list[bytes], books: list[list[list[int]]]) -> Iterator[Walk]:
    """One walk per part position, in 64-bit numbers where these hold all that is reckoned."""
    for raw, book in zip(trees, books):
        tree = Tree.unpacked(raw)
        limit = safe_limit(max(tree.points.shape[1], 1))
        narrow = not np.isinf(tree.radius[0]) and max(abs(x) for entry in book for x in entry) < limit
        yield Walk(tree if narrow else single_leaf(tree.points[np.argsort(tree.order)]), np.array(book, np.int64 if narrow else object))


def refitted(packed: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Codebooks after one round over all blocks: floor(sum / count) of what each entry owns, unused entries as they were."""
    entries, width = len(books[0]), len(books[0][0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), entries), np.int64)
        totals = np.zeros((len(books), entries, width), object)
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for part, walk in enumerate(walks(trees, books)):
                    count, total = walk.sums()
                    counts[part] += count
                    totals[part] += total.astype(object)
        part, entry, place = (x.ravel() for x in np.indices(totals.shape))
        sums = totals.ravel().tolist()  # in halves, so that long sums over the cluster hold
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "place": pa.array(place, pa.int32()),
                "n": pa.array(np.repeat(counts.ravel(), width), pa.int64()),
                "high": pa.array([s >> 32 for s in sums], pa.int64()),
                "low": pa.array([s & LOW for s in sums], pa.int64()),
            }
        )

    schema = "part int, entry int, place int, n long, high long, low long"
    found = (
        packed.select("trees").mapInArrow(releasing(task), schema)
        .where("n > 0")
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
        .collect()  # parts x entries x width numbers
    )
    new = [[list(entry) for entry in book] for book in books]
    for row in found:
        new[row["part"]][row["entry"]][row["place"]] = ((row["high"] << 32) + row["low"]) // row["n"]
    return new


def coded(packed: DataFrame, books: list[list[list[int]]], label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    largest = 2**63 - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(batch.column(2).to_pylist()):
                codes, errors = zip(*(walk.codes() for walk in walks(trees, books)))
                digits = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
                n, size = len(codes[0]), 2 * len(books)
                error = sum(e.astype(object) if e.dtype == object else e for e in errors)
                if error.dtype != object and max(int(e.max()) for e in errors) > largest // len(errors):
                    error = sum(e.astype(object) for e in errors)
                if error.dtype == object:
                    error = np.array([min(int(e), largest) for e in error], np.int64)
                columns = [batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()]
                columns += [pa.array([digits[k * size : (k + 1) * size] for k in range(n)]), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(releasing(task), f"vec_id long, label {label_type}, code string, error long")


@dataclass
class Fitted:
    """Codebooks (by part, entry, component), the written blocks, and the rows that vectors come from."""

    books: list[list[list[int]]]
    packed: DataFrame | None
    other: DataFrame
    label_type: str

    def digest(self) -> str:
        numbers = ",".join(str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def fitted(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Fitted:
    """Fit the codebooks on all vectors of `df`."""
    exact = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    numbers = F.col(vector) if exact else F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.alias("vector"), F.col(label).alias("label"))
    label_type = rows.schema["label"].dataType.simpleString()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    ordered = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.where(F.size("vector") % parts == 0).orderBy(*ordered).select(F.size("vector")).limit(1).collect()
    if not first:
        return Fitted([[] for _ in range(parts)], None, kept, label_type)
    width = first[0][0]
    fit = F.size("vector") == width
    started = kept.where(fit).orderBy(*ordered).limit(entries).select("vector").toArrow()
    numbers = scaled(started["vector"].combine_chunks(), width).reshape(-1, parts, width // parts)
    books = [numbers[:, p].tolist() for p in range(parts)]
    packed = written(blocks(kept.where(fit), width, parts, label_type), "vector-blocks")
    for _ in range(rounds):
        books = refitted(packed, books)
    return Fitted(books, packed, kept.where(~fit), label_type)


def compressed(df: DataFrame, **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector of `df`; `settings` are those of `fitted`."""
    model = fitted(df, **settings)
    other = model.other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = other
    if model.packed is not None:
        rows = written(coded(model.packed, model.books, model.label_type).unionByName(other), "vector-codes")
    # NULL labels meet by a key that is never NULL; the sums are one row per label.
    keyed = rows.withColumn("unlabelled", F.col("label").isNull()).withColumn(
        "label_key", F.coalesce(F.col("label").cast("string"), F.lit(""))
    )
    total, most = F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = keyed.groupBy("unlabelled", "label_key").agg(F.when(total > most, most).otherwise(total).cast("long").alias("label_error"))
    return join_checked(keyed, sums, ["unlabelled", "label_key"], "left").select(
        "vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256")
    )
