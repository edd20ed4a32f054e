"""Repeated substrings by suffix arrays.

Every window of `length` bytes is owned by its least k-gram hash. Windows that follow each other and have one owner form
a stretch; equal windows have equal owners, so only stretches of one owner can share a window. A stretch that occurs
again byte for byte (told by its owner and a 64-bit mark, and counted with map-side sums) repeats as a whole; that settles copies and the
inside of shared passages. What is left are owners with different stretches, at the edges of what is shared. These
stretches, each once, are dealt to shards by owner, a shard being cut into parts of bounded bytes. A part gets
a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's rule, run for all stretches in step; parts of
one shard are merged by a binary search of the windows of one in the suffix array of the other.

Defined results: text NULL is empty; a text shorter than a window keeps everything; rows that repeat, also with one id,
are occurrences of their own; matches never cross texts, and a match is one of bytes, whatever characters they cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrays import SYMBOLS, as_long, mixed, powers, prefix_hashes, range_hashes, slices, utf8
from lectern.llm.data import text_of
from lectern.sources.storage import written

LENGTH = 200
GRAM = 48
MOST_STARTS = 512        # windows of a stretch; a longer run of one owner is cut
PART_BYTES = 4 << 20     # of stretches in a part of a shard
SHARD_BYTES = 2 << 20    # of stretches that a shard has on average
BROADCAST_ROWS = 1 << 21


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least (or largest) of each `width` values in a row, by running picks over blocks from both sides."""
    n = len(values)
    size = -(-n // width) * width
    edge = np.uint64(0xFFFFFFFFFFFFFFFF) if pick is np.minimum else np.uint64(0)
    blocks = np.concatenate([values, np.full(size - n, edge, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The stretches of all texts, in order: text, start in the text, begin in `data`, number of windows, owner, mark of
    the bytes, and whether the owner occurs more than once (windows of the stretch may then equal each other)."""
    width, n = length - gram + 1, len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return {name: none for name in ("text", "start", "begin", "n", "again")} | {"owner": none.view(np.uint64), "mark": none.view(np.uint64)}
    hashes = prefix_hashes(SYMBOLS[data])
    grams = mixed((hashes[gram:] - hashes[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    least = sliding(grams, width, np.minimum)
    valid = np.arange(length, n + 1) <= np.repeat(offsets[1:], np.diff(offsets))[: n - length + 1]
    least[~valid] = 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    begin = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - begin
    if len(size) and size.max() > MOST_STARTS:
        cuts = -(-size // MOST_STARTS)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(begin, cuts) + nth * MOST_STARTS
        size = np.minimum(np.repeat(size, cuts) - nth * MOST_STARTS, MOST_STARTS)
    owner = least[begin]
    # Places whose gram is the least of some window, by value: does the next place with the owner lie in the stretch?
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(grams == sliding(padded, width, np.maximum))
    values, number = np.unique(grams[places], return_inverse=True)
    keys = np.sort(number * n + places)
    mine = np.searchsorted(values, owner) * n
    at = np.searchsorted(keys, mine + begin) + 1
    again = np.zeros(len(begin), bool)
    there = at < len(keys)
    again[there] = keys[at[there]] <= (mine + begin + size + width - 2)[there]
    text = np.searchsorted(offsets, begin, side="right") - 1
    mark = mixed(range_hashes(hashes, begin, begin + size + length - 1) + size.astype(np.uint64) * np.uint64(3))
    return {"text": text, "start": begin - offsets[text], "begin": begin, "n": size, "owner": owner, "mark": mark, "again": again}


NAMES = ["owner", "mark", "start", "n", "again"]
MARKS = ["owner", "mark"]


def indexed(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key_a, key_b, owner, mark, start, n, again): the stretches of each text, named by two hashes of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = stretches(*utf8(part.column(2)), length, gram)
                text = pa.array(found["text"])
                columns = [part.column(0).take(text), part.column(1).take(text)]
                for name in NAMES:
                    values = found[name]
                    columns.append(pa.array(as_long(values) if values.dtype == np.uint64 else values))
                yield pa.RecordBatch.from_arrays(columns, ["key_a", "key_b", *NAMES])

    schema = "key_a long, key_b long, owner long, mark long, start long, n long, again boolean"
    return rows.select("key_a", "key_b", "text").mapInArrow(task, schema)


def distinct_stretches(index: DataFrame) -> DataFrame:
    """(owner, mark, n, times, again, kinds): each stretch once; `kinds` stretches have its owner."""
    once = index.groupBy(*MARKS).agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("times"), F.max("again").alias("again")
    )
    return once.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("owner")))


def extracted(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(owner, mark, n, bytes) of the wanted stretches, once a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = None if spread is None else spread.value
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(0))
                found = stretches(data, offsets, length, gram)
                pick = np.arange(len(found["owner"]))
                if owners is not None:
                    at = np.searchsorted(owners, found["owner"])
                    at[at == len(owners)] = 0
                    pick = np.flatnonzero(owners[at] == found["owner"]) if len(owners) else pick[:0]
                marks = zip(found["owner"][pick].tolist(), found["mark"][pick].tolist())
                pick = pick[[mark not in sent and not sent.add(mark) for mark in marks]] if len(pick) else pick
                begin, raw = found["begin"][pick].tolist(), data.tobytes()
                columns = [pa.array(as_long(found[name][pick])) for name in MARKS]
                columns.append(pa.array(found["n"][pick]))
                size = (found["n"][pick] + length - 1).tolist()
                columns.append(pa.array([raw[a : a + k] for a, k in zip(begin, size)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*MARKS, "n", "bytes"])

    owners = wanted.select("owner").distinct()
    spread = None
    if owners.count() <= BROADCAST_ROWS:  # at most 16 MB; beyond that all stretches are cut out and met in a join
        values = np.sort(owners.toPandas()["owner"].to_numpy(np.int64).view(np.uint64))
        spread = rows.sparkSession.sparkContext.broadcast(values)
    found = rows.select("text").mapInArrow(task, "owner long, mark long, n long, bytes binary")
    once = found.groupBy(*MARKS).agg(F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    return once.join(wanted.select(*MARKS), MARKS)


def suffix_array(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each).

    `separator` is the number of the stretch a byte ends, or 0: suffixes of different stretches differ where one ends.
    Larsson-Sadakane: after each round the ranks of h bytes are known, and only groups of equal rank are sorted again,
    by the rank h bytes on.
    """
    n = len(data)
    symbols = np.where(separator > 0, separator + 255, data.astype(np.int64))
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(order: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rank of a group: the place of its last member."""
        starts = np.flatnonzero(new)
        lasts = np.append(starts[1:], len(order)) - 1
        return base[np.repeat(lasts, np.diff(np.append(starts, len(order))))]

    place = np.arange(n)
    sorted_symbols = symbols[order]
    rank[order] = ranked(order, np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]), place)
    h = 1
    while True:
        group = rank[order]
        alone = np.ones(n, bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[1:] != group[:-1]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        members = order[at]
        ahead = members + h
        # A suffix that ends within h bytes holds a separator and is alone already.
        second = rank[np.minimum(ahead, n - 1)]
        keys = group[at] * n + second
        again = np.argsort(keys, kind="stable")
        members, keys = members[again], keys[again]
        order[at] = members
        rank[members] = ranked(members, np.concatenate([[True], keys[1:] != keys[:-1]]), at)
        h *= 2
    return order, rank


class Part:
    """Stretches laid end to end, each with a separator behind it, and their suffix array."""

    def __init__(self, blobs: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int):
        self.length, self.windows, self.owners = length, starts, owners
        sizes = np.array([len(b) for b in blobs], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.data = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
        self.separator = np.zeros(len(self.data), np.int64)
        self.separator[self.begin + sizes] = np.arange(1, len(blobs) + 1)
        self.order, self.rank_place = suffix_array(self.data, self.separator)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.words = np.zeros(len(self.data), np.uint64)  # eight bytes from each place, the first one highest
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : k + len(self.data)].astype(np.uint64)
        self.rest = np.repeat(self.begin + sizes, sizes + 1) - np.arange(len(self.data))  # bytes up to the separator

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows of all stretches: where they start, and the stretch each belongs to."""
        stretch = np.repeat(np.arange(len(self.windows)), self.windows)
        nth = np.arange(len(stretch)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        return self.begin[stretch] + nth, stretch

    def lcp(self) -> np.ndarray:
        """For each place, bytes that its suffix shares with the one before it in order, by Kasai's rule: a place
        shares one less than the place before it did, at least. All stretches go on in step."""
        n, out = len(self.data), np.zeros(len(self.data), np.int64)
        shared = np.zeros(len(self.begin), np.int64)
        sizes = self.rest[self.begin]
        for step in range(int(sizes.max())):
            live = np.flatnonzero(step < sizes)
            here = self.begin[live] + step
            before = self.order[np.maximum(self.rank_place[here] - 1, 0)]
            h = np.maximum(shared[live] - 1, 0)
            h[self.rank_place[here] == 0] = 0
            most = np.minimum(np.minimum(self.rest[here], self.rest[before]), self.length)
            go = np.flatnonzero((h < most) & (self.rank_place[here] > 0))
            while len(go):
                x, y = np.minimum(here[go] + h[go], n - 1), np.minimum(before[go] + h[go], n - 1)
                gain = equal_bytes(self.words[x] ^ self.words[y])
                h[go] = np.minimum(h[go] + gain, most[go])
                go = go[(gain == 8) & (h[go] < most[go])]
            out[here] = h
            shared[live] = h
        return out

    def repeated(self) -> np.ndarray:
        """Of each window, whether it occurs again in this part."""
        places, _ = self.places()
        lcp = self.lcp()
        at = self.rank_place[places]
        after = self.order[np.minimum(at + 1, len(self.order) - 1)]
        with_after = np.where(at + 1 < len(self.order), lcp[after], 0)
        return (lcp[places] >= self.length) | (with_after >= self.length)

    def found_in(self, other: Part) -> np.ndarray:
        """Of each window, whether it occurs in `other`, by a binary search of its suffix array."""
        places, _ = self.places()
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(other.order))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less = self.compared(places[open_], other, other.order[middle]) > 0
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        inside = low < len(other.order)
        out = np.zeros(len(places), bool)
        out[inside] = self.compared(places[inside], other, other.order[low[inside]]) == 0
        return out

    def compared(self, mine: np.ndarray, other: Part, theirs: np.ndarray) -> np.ndarray:
        """1, 0 or -1 as windows of this part come after, begin or come before suffixes of the other; a suffix that
        ends first comes after, as separators are the largest symbols."""
        out = np.zeros(len(mine), np.int64)
        open_ = np.arange(len(mine))
        for h in range(0, self.length, 8):
            width = min(8, self.length - h)
            cut = np.uint64(8 * (8 - width))
            x, y = mine[open_] + h, theirs[open_] + h
            ends = other.rest[theirs[open_]] < h + width
            y = np.minimum(y, len(other.data) - 1)
            a, b = self.words[x] >> cut, other.words[y] >> cut
            left = np.clip(other.rest[theirs[open_]] - h, 0, width)  # bytes before the separator
            shift = (8 * (width - left)).astype(np.uint64)
            whole = left > 0
            a_cut = np.where(whole, a >> np.where(whole, shift, 0).astype(np.uint64), 0)
            b_cut = np.where(whole, b >> np.where(whole, shift, 0).astype(np.uint64), 0)
            out[open_] = np.where(a_cut > b_cut, 1, np.where(a_cut < b_cut, -1, np.where(ends, -1, 0)))
            open_ = open_[out[open_] == 0]
            if not len(open_):
                break
        return out


def equal_bytes(difference: np.ndarray) -> np.ndarray:
    """Leading bytes that are zero, of eight."""
    out = np.zeros(len(difference), np.int64)
    for k in range(1, 9):
        out += (difference >> np.uint64(64 - 8 * k)) == 0
    return out


RUNS = "owner long, mark long, low long, high long"


def runs(table: pa.Table, flags: np.ndarray, windows: np.ndarray) -> pa.Table:
    """Rows of RUNS from a flag per window: [low, high) of the windows of a stretch that repeat."""
    stretch = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(stretch)) - np.repeat(np.cumsum(windows) - windows, windows)
    edge = np.concatenate([[True], stretch[1:] != stretch[:-1]]) if len(stretch) else np.empty(0, bool)
    before = np.concatenate([[False], flags[:-1]]) & ~edge
    after = np.concatenate([flags[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    low, high = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    rows = table.take(pa.array(stretch[low]))
    return pa.table(
        {
            "owner": rows["owner"], "mark": rows["mark"],
            "low": pa.array(nth[low]), "high": pa.array(nth[high] + 1),
        }
    )


def part_of(table: pa.Table, length: int) -> Part:
    return Part(table["bytes"].to_pylist(), table["owner"].to_numpy(), table["n"].to_numpy(), length)


def repeats(found: DataFrame, length: int, shards: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of RUNS: which windows of the stretches occur in another one, or twice in their own."""

    def alone(table: pa.Table) -> pa.Table:
        part = part_of(table, length)
        return runs(table, part.repeated(), part.windows)

    def merged(table: pa.Table) -> pa.Table:
        first = table["part"].to_numpy() == table["i"].to_numpy()
        sides = [table.take(np.flatnonzero(side)) for side in (first, ~first)]
        parts = [part_of(side, length) for side in sides]
        flags = [parts[0].found_in(parts[1]), parts[1].found_in(parts[0])]
        return pa.concat_tables(runs(side, flag, part.windows) for side, flag, part in zip(sides, flags, parts))

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    ordered = Window.partitionBy("shard").orderBy(*MARKS).rowsBetween(Window.unboundedPreceding, -1)
    light = dealt.select("shard", *MARKS, F.length("bytes").alias("size"))
    placed = light.withColumn("part", F.floor(F.coalesce(F.sum("size").over(ordered), F.lit(0)) / part_bytes)).drop("size")
    placed = written(placed, "parts")
    located = dealt.join(placed, ["shard", *MARKS])
    inside = located.groupBy("shard", "part").applyInArrow(alone, RUNS)
    # Parts that share an owner, which then reaches from one to the other; all others have nothing in common.
    spans = placed.groupBy("shard", "owner").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    across = placed.join(spans, ["shard", "owner"])
    spanned = across.select("shard", "owner", "part").distinct()
    left, right = spanned.withColumnRenamed("part", "i"), spanned.withColumnRenamed("part", "j")
    pairs = left.join(right, ["shard", "owner"]).where("i < j").select("shard", "i", "j").distinct()
    meets = pairs.select("shard", "i", "j", F.explode(F.array("i", "j")).alias("part"))
    shared = located.join(spans.select("shard", "owner"), ["shard", "owner"], "left_semi")
    between = shared.join(meets, ["shard", "part"]).groupBy("shard", "i", "j").applyInArrow(merged, RUNS)
    return inside.unionByName(between)


def covered(rows: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from lists of repeated windows per text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                spans: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"]) for r in found or ()):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high + length - 1)
                    else:
                        spans.append([low, high + length - 1])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            columns = [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (*[pa.int64()] * 3, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    joined = rows.join(ranges, ["key_a", "key_b"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `df`."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(7), "text").alias("key_b"))
    index = written(indexed(rows, length, gram), "stretches")
    once = written(distinct_stretches(index).where("times > 1 or kinds > 1 or again"), "distinct")
    # An owner all of whose stretches repeat as a whole leaves nothing to find.
    asked = once.where("times = 1").select("owner").distinct()
    wanted = once.join(asked, "owner", "left_semi").where("kinds > 1 or again")
    found = written(extracted(rows, wanted, length, gram), "bytes")
    size = found.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = repeats(found, length, max(1, size // SHARD_BYTES))
    whole = once.where("times > 1").select(*MARKS, F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    # One row a stretch: a stretch with many rows must not multiply the rows of its texts.
    hits = whole.unionByName(parts).groupBy(*MARKS).agg(F.collect_set(F.struct("low", "high")).alias("hits"))
    placed = index.select("key_a", "key_b", *MARKS, "start").join(written(hits, "hits"), MARKS)
    spread = placed.groupBy("key_a", "key_b", "start").agg(F.first("hits").alias("hits"))
    moved = spread.select(
        "key_a", "key_b", F.explode(F.transform("hits", lambda h: F.struct((h["low"] + F.col("start")).alias("low"), (h["high"] + F.col("start")).alias("high")))).alias("r")
    )
    ranges = moved.groupBy("key_a", "key_b").agg(F.collect_set("r").alias("ranges"))
    return covered(rows, ranges, length)
