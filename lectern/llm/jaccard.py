"""N-gram Jaccard join: sets of word shingles, linked where 100 * intersection >= percent * union.

Equal sets are one vertex. Two linked sets share a shingle among the first n - ceil(percent * n / 100) + 1 of each in
any one order; with frequent shingles last, such a prefix is mostly made of rare ones. Sets that meet at a shingle and
whose sizes allow a link are tied together: few of them pair by pair, where the bit counts of two bitmaps can still
rule a link out, more of them to one of their number. The tied groups are the candidates. A group is cut, by set size, into
tiles of bounded bytes. Tiles whose size bands allow a link meet in pairs: inside, a bitmap of each set (the parity of
its shingles per hash slot) bounds the overlap from above by a bit count, and what passes is decided by intersecting
the sorted arrays. A set that is already reached is not compared again, so the pairs that come out are a spanning
forest of the links, never all pairs of a group.

Defined results: text NULL or without words has the empty set, which is linked with nothing; every row is a document
of its own, also where ids repeat; rows without an id link like others, but do not count as the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import graph
from lectern.llm.arrays import LIGHT_SLICE_BYTES, as_long, mixed, releasing, shingles, slices, utf8, word_hashes, words
from lectern.llm.data import text_of
from lectern.llm.rows import numbered, without
from lectern.sources.storage import written

WORDS = 4
PERCENT = 85
COMMON = 1 << 20        # shingles that are put last, most frequent ones last of all: enough for those of more than FEW sets
OFTEN = 4               # times a shingle is counted to be put last
SEEN = 2                # times a shingle is met in a stretch of prefixes to be counted for that
STRETCH = 1 << 21       # shingles of a stretch
FEW = 32                # sets at a shingle that are tied pair by pair; more of them make a group, linked or not
TILE_BYTES = 16 << 20   # of arrays in a tile
BROADCAST_ROWS = 1 << 20


def sets_of(part: pa.RecordBatch, column: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingles of each text, and those of all texts one after the other."""
    data, offsets = utf8(part.column(column))
    starts, ends, counts = words(data, offsets)
    found, where = shingles(word_hashes(data, starts, ends), counts, size)
    sets = [np.unique(found[a:b]) for a, b in zip(where.tolist(), where[1:].tolist())]
    return sets, np.concatenate(sets) if sets else found


def kept(n: int, percent: int) -> int:
    """How many shingles of n make the prefix."""
    return n + (-percent * n // 100) + 1 if n else 0


def common(df: DataFrame, size: int, percent: int) -> np.ndarray:
    """Frequent shingles of prefixes in plain order, the least frequent first. Any order gives the same links; this one
    keeps shingles that many sets have out of the prefixes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= SEEN
            return pa.RecordBatch.from_pydict({"shingle": pa.array(as_long(values[often])), "times": pa.array(times[often])})

        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                found = [own[: kept(len(own), percent)] for own in sets_of(part, 0, size)[0]]
                held += found
                n += sum(map(len, found))
                if n >= STRETCH:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    counts = df.select("text").mapInArrow(releasing(task), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counts.where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "shingle").limit(COMMON).toPandas()
    return top["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prefixed(df: DataFrame, size: int, percent: int, last: np.ndarray) -> DataFrame:
    """(row, doc_id, n, vertex, prefix, bits) of each text; `vertex` is a digest of its set, `bits` its bitmap.

    The first text of a task that has a set brings its prefix and bitmap; later ones only name it.
    """
    spread = df.sparkSession.sparkContext.broadcast(last)  # at most COMMON numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_value = np.argsort(spread.value)
        sorted_last = spread.value[by_value]
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                sets, flat = sets_of(part, 2, size)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(n)
                if len(sorted_last) and len(flat):
                    at = np.minimum(np.searchsorted(sorted_last, flat), len(sorted_last) - 1)
                    rank = np.where(sorted_last[at] == flat, by_value[at] + 1, 0)
                else:
                    rank = np.zeros(len(flat), np.int64)
                vertex = as_long(digests(flat, n))
                prefixes, bits = [], []
                for own, v, a, b in zip(sets, vertex.tolist(), (ends - n).tolist(), ends.tolist()):
                    if v in sent:
                        prefixes.append(own[:0])
                        bits.append(None)
                        continue
                    sent.add(v)
                    order = np.argsort(rank[a:b], kind="stable") if rank[a:b].any() else slice(None)
                    prefixes.append(own[order][: kept(len(own), percent)])
                    bits.append(bitmap(own, slots(len(own))).tobytes())
                sizes = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                values = as_long(np.concatenate(prefixes)) if prefixes else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
                columns = [part.column(0), part.column(1), pa.array(n), pa.array(vertex), lists, pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "vertex", "prefix", "bits"])

    schema = "row long, doc_id long, n long, vertex long, prefix array<long>, bits binary"
    return df.select("row", "doc_id", "text").mapInArrow(releasing(task), schema)


def digests(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A digest of each of the sets that lie one after the other."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed(flat + np.uint64(1)), out=total[1:])
    ends = np.cumsum(n)
    return mixed(total[ends] - total[ends - n] + n.astype(np.uint64))


def ties(base: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that share a prefix shingle and may be linked.

    Rows come sorted by (shingle, n, vertex); a run is broken where neighbouring sizes allow no link. Up to FEW sets of
    a run pair up, where sizes and the places of the shingle allow a link, and bitmaps are asked; in a longer run each
    set is tied to the first.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            again = (rows[0][1:] == rows[0][:-1]) & (rows[2][1:] == rows[2][:-1])  # one set from several tasks
            rows = [column[np.append(True, ~again)[: len(column)]] for column in rows]
            shingle, n, vertex, left = rows
            if not len(n):
                continue
            new = np.ones(len(n), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (100 * n[:-1] < percent * n[1:])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(n)))
            length, first = np.repeat(lengths, lengths), np.repeat(vertex[starts], lengths)
            run = np.cumsum(new)
            long = (length > FEW) & (first != vertex)
            found = [(vertex[long], first[long], np.zeros(int(long.sum()), bool))]
            i = np.flatnonzero((length > 1) & (length <= FEW))
            for step in range(1, FEW):
                i = i[i + step < len(n)]
                i = i[run[i] == run[i + step]]
                if len(i):
                    j = i + step
                    most, both = np.minimum(left[i], left[j]), n[i] + n[j]
                    ok = 100 * most >= percent * (both - most)
                    found.append((vertex[i[ok]], vertex[j[ok]], np.ones(int(ok.sum()), bool)))
            a, b, ask = (np.concatenate(columns) for columns in zip(*found))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b)), "ask": pa.array(ask)})
            at, k = int(starts[-1]), int(lengths[-1])  # the run may go on: its first set and its last ones stand for it
            keep = np.arange(at, at + k) if k <= FEW else np.append(at, np.arange(at + k - FEW, at + k))
            held = [column[keep] for column in rows]

    rows = base.select(F.posexplode("prefix").alias("place", "shingle"), "n", "vertex")
    rows = rows.select("shingle", "n", "vertex", (F.col("n") - F.col("place")).alias("left"))
    ordered = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "vertex")
    tied = ordered.mapInArrow(releasing(task), "a long, b long, ask boolean").groupBy("a", "b").agg(F.min("ask").alias("ask"))
    tied = written(tied.where("a <> b"), "ties")
    return tied.where("not ask").select("a", "b").unionByName(possible(tied.where("ask"), sets, percent))


def possible(tied: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave enough overlap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            columns = (batch.column(4).to_pylist(), batch.column(5).to_pylist())
            apart = [differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*columns)]
            most = (n + m - np.array(apart, np.int64)) // 2
            ok = 100 * most >= percent * (n + m - most)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[ok]), "b": pa.array(b[ok])})

    one = sets.select(F.col("vertex").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    two = sets.select(F.col("vertex").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    rows = tied.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")
    return rows.mapInArrow(releasing(task), "a long, b long")


def slots(n: int) -> int:
    """Slots of a bitmap for a set of n: a power of two, n at least."""
    return max(64, 1 << max(n - 1, 1).bit_length())


def bitmap(members: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the members in each slot. Half the slots of a map, laid over the others, make the smaller map."""
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Slots in which two bitmaps differ: a lower bound of the members that only one of the sets has."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap per set, all of the size that suits the largest."""
    bits = slots(max(map(len, sets)))
    return np.stack([bitmap(own, bits) for own in sets])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of linked sets that span all links; where there are two sides, links across them only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    marks = bitmaps(sets)
    across = bool(side.any() and not side.all())
    open_ = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            near = open_ & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            if across:
                near &= side != side[x]
            other = np.flatnonzero(near)
            if not len(other):
                continue
            apart = np.bitwise_count(marks[other] ^ marks[x]).sum(axis=1, dtype=np.int64)
            both = sizes[other] + sizes[x]
            most = (both - apart) // 2
            for y in other[100 * most >= percent * (both - most)].tolist():
                shared = overlap(sets[x], sets[y])
                if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                    out.append((x, y))
                    open_[y] = False
                    queue.append(y)
    return out


def tiles(groups: DataFrame, percent: int) -> DataFrame:
    """(component, vertex, n, named, tile, i, j): each set of a group once for every pair of tiles that it belongs to."""
    ordered = Window.partitionBy("component").orderBy("n", "vertex")
    before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    placed = written(groups.withColumn("tile", F.floor(F.coalesce(before, F.lit(0)) * 8 / TILE_BYTES)), "tiles")
    bands = placed.groupBy("component", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = bands.select("component", F.col("tile").alias("i"), F.col("high").alias("most"))
    right = bands.select("component", F.col("tile").alias("j"), F.col("low").alias("least"))
    pairs = left.join(right, "component").where((F.col("i") <= F.col("j")) & (100 * F.col("most") >= percent * F.col("least")))
    meets = pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return placed.join(meets, ["component", "tile"])


def links(df: DataFrame, tiled: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): vertices whose sets are linked, a spanning forest for each pair of tiles."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies without an id are sent once a task
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                sets, flat = sets_of(part, 0, size)
                n = np.array([len(s) for s in sets], np.int64)
                vertex = as_long(digests(flat, n)).tolist()
                new = [i for i, v in enumerate(vertex) if n[i] and v not in sent and not sent.add(v)]
                where = np.concatenate([[0], np.cumsum(n[new])])
                flat = np.concatenate([sets[i] for i in new]) if new else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(as_long(flat)))
                yield pa.RecordBatch.from_arrays([pa.array([vertex[i] for i in new], pa.int64()), lists], ["vertex", "members"])

    def compared(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("vertex", "ascending")])
        vertex = table["vertex"].to_numpy()
        once = np.flatnonzero(np.concatenate([[True], vertex[1:] != vertex[:-1]]))
        table, vertex = table.take(once), vertex[once]
        lists = table["members"].combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        sets = np.split(lists.flatten().to_numpy().view(np.uint64), ends[:-1])
        found = forest(sets, table["tile"].to_numpy() != table["i"].to_numpy(), percent)
        a, b = (np.array([pair[k] for pair in found], np.int64) for k in (0, 1))
        return pa.table({"a": vertex[a], "b": vertex[b]})

    named = tiled.select("named").where("named is not null").distinct()
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    rows = df.join(named, df["doc_id"] == named["named"], "left_semi").unionByName(df.where("doc_id is null"))
    sets = rows.select("text").mapInArrow(releasing(arrays), "vertex long, members array<long>")
    return sets.join(tiled, "vertex").groupBy("component", "i", "j").applyInArrow(compared, "a long, b long")


def grouped(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, doc_id, n, group, component_id) of every (row, doc_id, text) row; rows of linked sets share `group`, rows
    of the empty set have none."""
    base = written(prefixed(rows, size, percent, common(rows, size, percent)), "prefixes")
    full = base.where("n > 0")
    firsts = [F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("named")]
    sets = written(full.groupBy("vertex").agg(*firsts), "sets")
    tied = graph.components(ties(full, sets, percent))
    tiled = tiles(tied.join(sets.select("vertex", "n", "named"), "vertex"), percent)
    linked = graph.components(links(rows, tiled, size, percent))
    smallest = linked.join(sets.select("vertex", "named"), "vertex").groupBy("component").agg(F.min("named").alias("least"))
    least = linked.join(smallest, "component").select("vertex", "component", "least")
    ids = sets.join(least, "vertex", "left").select(
        "vertex", F.coalesce("component", "vertex").alias("group"), F.coalesce("least", "named").alias("component_id")
    )
    found = full.join(ids, "vertex").select("row", "doc_id", "n", "group", "component_id")
    none = F.lit(None).cast("long").alias("group")
    alone = base.where("n = 0").select("row", "doc_id", "n", none, F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `df`; ids are whole numbers."""
    none = F.lit(None).cast("long").alias("row")
    rows = df.select(none, F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return grouped(rows, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` that stay: of each component the first by id, rows without an id last and those of equal ids
    in any one order; rows without words stay."""
    whole = numbered(df)
    rows = whole.select("row", F.col(f"carried.`{doc_id}`").cast("long").alias("doc_id"), text_of(f"carried.`{text}`").alias("text"))
    found = written(grouped(rows, size, percent).where("group is not null").select("row", "doc_id", "group"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    stay = found.groupBy("group").agg(first["row"].alias("row")).select("row")
    gone = found.select("row").join(stay, "row", "left_anti")
    return without(whole, written(gone, "near-copies")).select("carried.*")
