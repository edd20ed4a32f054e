"""Byte-level BPE by ranks: pieces of equal length bucket merge in step, as rows of padded matrices.

Texts are cut into the pieces of the tokenizer's pattern (contractions, letters, digits, other signs, white space) by
comparing classes of neighbouring characters, a whole slice of texts at a time. What class a character has is asked of
the library itself, once for each character a worker meets, so that its version of Unicode decides. Every distinct
piece is encoded once for as long as a task remembers it: pieces lie in the rows of matrices whose width is the next
power of two, in every round each row merges its leftmost pair of least rank, found in a hashed table of all pairs whose
bytes together are a token, and the columns behind it move up; rows without a pair leave. A piece of more than WIDEST bytes
is a row of its own, in which a round merges all pairs of the least rank that the rule would take one after the other.

Texts above PART bytes are cut before a white space that follows a printable ASCII character, where a piece ends in any
case, so memory does not grow with the text as long as it has such places.

Defined results: NULL text encodes as empty; rows that repeat are encoded each on its own; extra columns stay with
`encoded` and `decoded`; ids without a token, and NULL, decode to nothing; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import SYMBOLS, mixed, prefix_hashes, range_hashes, releasing, utf8
from lectern.llm.data import packed, text_of
from lectern.llm.wordtable import Places, Ragged

WIDEST = 256        # bytes of a piece that shares a matrix with others
CELLS = 1 << 18     # cells of a matrix
PART = 1 << 20      # bytes of text at a time
PIECES = 1 << 18    # distinct pieces a task remembers
NONE = np.int32(2**31 - 1)

LETTER, DIGIT, OTHER, SPACE, UNKNOWN = range(5)
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Classes:
    """The class of every character, asked of the library where it is not known yet.

    A toy vocabulary joins one ASCII character with any byte: it shows whether a character behind it is in the same piece.
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        single = {bytes([b]): b for b in range(256)}
        self.probes = []
        for kind, sign in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
            ranks = single | {sign.encode() + bytes([b]): 256 + b for b in range(256)}
            toy = tiktoken.Encoding("toy", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.probes.append((kind, sign, toy))

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        new = points[found == UNKNOWN]
        if len(new):
            for point in np.unique(new).tolist():
                self.table[point] = next(
                    (kind for kind, sign, toy in self.probes if toy.encode_ordinary(sign + chr(point))[0] >= 256), SPACE
                )
            found = self.table[points]
        return found


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        lead, where = points[wide], at[wide]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        b1, b2, b3 = (padded[where + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two = ((lead & 0x1F) << 6) | b1
        three = ((lead & 0x0F) << 12) | (b1 << 6) | b2
        four = ((lead & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
        points[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return points, at


def pieces(data: np.ndarray, offsets: np.ndarray, classes: Classes) -> np.ndarray:
    """The bytes at which the pieces of all texts begin; texts are one after the other, cut at `offsets`."""
    if not len(data):
        return np.empty(0, np.int64)
    points, at = code_points(data)
    n = len(points)
    kind = classes.of(points)
    opens = np.zeros(n + 1, bool)  # a text begins here, or the last one ends
    opens[np.searchsorted(at, offsets)] = True
    begins = opens[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    # The last white space before something else is a piece of its own, or the head of the next piece if it is a blank.
    inner = (kind[runs] == SPACE) & ~opens[ends]
    last = ends[inner] - 1
    begins[last] = True
    begins[ends[inner][points[last] == 32]] = False
    # A lone apostrophe at which a piece begins takes the letters of a contraction along.
    lone = (points[runs] == 39) & (ends - runs == 1) & begins[runs] & ~opens[ends]
    for p in runs[lone]:
        first = points[p + 1]
        if first in (100, 109, 115, 116):  # d m s t
            stop = p + 2
        elif p + 2 < n and not opens[p + 2] and (first, points[p + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            stop = p + 3
        else:
            continue
        begins[p + 1] = False
        if stop < n:
            begins[stop] = True
    return at[np.flatnonzero(begins)]


class Pairs:
    """Ranks of pairs of tokens, in a hashed table of all pairs whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        left, right, whole = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        self.known = Places(len(left) + 1)
        self.known.insert(self._key(np.array(left, np.int64), np.array(right, np.int64)))
        self.whole = np.array([*whole, NONE], np.int32)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        order = sorted(self.ranks.items(), key=lambda entry: entry[1])
        size = order[-1][1] + 1
        sizes = np.zeros(size, np.int64)
        sizes[[rank for _, rank in order]] = [len(token) for token, _ in order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(token for token, _ in order), np.uint8)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One to one, so that different pairs never share a key, and never 0."""
        return mixed((((left + 1) << 32) | (right + 1)).astype(np.uint64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none or a side is below 0."""
        out = np.full(left.shape, NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        out[real] = self.whole[self.known.find(self._key(left[real].astype(np.int64), right[real].astype(np.int64)))]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens one after the other, and how many each has; ids without a token have none."""
        real = (ids >= 0) & (ids < len(self.starts) - 1)
        safe = np.where(real, ids, 0).astype(np.int64)
        begin = self.starts[safe]
        sizes = np.where(real, self.starts[safe + 1] - begin, 0)
        before = np.cumsum(sizes) - sizes
        where = np.repeat(begin - before, sizes) + np.arange(sizes.sum())
        return self.bytes[where], sizes


@lru_cache(maxsize=2)
def pairs(path: str) -> Pairs:
    return Pairs(path)


@lru_cache(maxsize=1)
def character_classes() -> Classes:
    return Classes()


def merged(ids: np.ndarray, table: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The final tokens of every row of a padded matrix (-1 behind the last one), and how many there are."""
    out, sizes = ids.copy(), np.zeros(len(ids), np.int64)
    rows = np.arange(len(ids))
    rank = table.rank(ids[:, :-1], ids[:, 1:])
    while len(rows):
        column = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), column] if rank.shape[1] else np.full(len(rows), NONE)
        over = best == NONE
        if over.any():
            out[rows[over], : ids.shape[1]] = ids[over]
            out[rows[over], ids.shape[1] :] = -1
            sizes[rows[over]] = (ids[over] >= 0).sum(axis=1)
            live = ~over
            rows, ids, rank, column, best = rows[live], ids[live], rank[live], column[live], best[live]
            if not len(rows):
                break
        each = np.arange(len(rows))
        ids[each, column] = best
        after = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, after + (after > column[:, None]), axis=1)
        after = after[:-1]
        rank = np.take_along_axis(rank, after + (after >= column[:, None]), axis=1)
        before = np.flatnonzero(column > 0)
        rank[before, column[before] - 1] = table.rank(ids[before, column[before] - 1], ids[before, column[before]])
        behind = np.flatnonzero(column < rank.shape[1])
        rank[behind, column[behind]] = table.rank(ids[behind, column[behind]], ids[behind, column[behind] + 1])
    return out, sizes


def merged_long(ids: np.ndarray, table: Pairs) -> np.ndarray:
    """The final tokens of one long row.

    A round takes the pairs of least rank from left to right, every second of a chain of overlapping ones, up to the first
    whose merge makes a pair of that rank or less: just what the rule takes one after the other. Merged places stay,
    passed over by links, until half of the row is gone.
    """
    while True:
        n = len(ids)
        ids = ids.copy()
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: no neighbour
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = table.rank(ids[:-1], ids[1:])
        there, alive = np.ones(n, bool), n
        while alive > n // 2:
            least = rank.min() if n else NONE
            if least == NONE:
                return ids[there]
            at = np.flatnonzero(rank == least)
            chained = np.append(False, right[at[:-1]] == at[1:])
            heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - heads) % 2 == 0]
            gone = right[at]
            # What lies to the left has been merged by then, what lies to the right has not.
            held = left[at]
            previous = np.where(held >= 0, ids[held], -1)
            taken = np.append(False, gone[:-1] == held[1:])
            previous[taken] = least
            beyond = right[gone]
            following = np.where(beyond < n, ids[np.minimum(beyond, n - 1)], -1)
            whole = np.full(len(at), least, np.int32)
            made = np.minimum(table.rank(previous, whole), table.rank(whole, following))
            early = np.flatnonzero(made <= least)
            if len(early):
                at, gone, beyond = (x[: early[0] + 1] for x in (at, gone, beyond))
            ids[at] = least
            there[gone] = False
            alive -= len(gone)
            rank[gone] = NONE
            right[at] = beyond
            left[beyond[beyond < n]] = at[beyond < n]
            again = np.unique(np.concatenate([at, left[at][left[at] >= 0]]))
            to = right[again]
            rank[again] = table.rank(ids[again], np.where(to < n, ids[np.minimum(to, n - 1)], -1))
        ids = ids[there]


class PieceIds:
    """The ids of pieces that a task has met, by place."""

    def __init__(self, path: str, limit: int = PIECES):
        self.pairs, self.classes, self.limit = pairs(path), character_classes(), limit
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = Places(self.limit), Ragged(np.int32)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """The next places for pieces that are new."""
        sizes = ends - starts
        found: list = [None] * len(starts)
        raw = data.tobytes()
        rest = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            own = self.pairs.ranks.get(raw[a:b])  # a piece that is a token as a whole is that token
            if own is None:
                rest.append(i)
            else:
                found[i] = np.array([own], np.int32)
        rest = np.array(rest, np.int64)
        width = 2
        while width <= WIDEST:
            bucket = rest[(sizes[rest] <= width) & (sizes[rest] > width // 2)]
            for k in range(0, len(bucket), step := max(CELLS // width, 1)):
                some = bucket[k : k + step]
                where = starts[some, None] + np.arange(width)
                inside = where < ends[some, None]
                ids = np.where(inside, self.pairs.single[data[np.minimum(where, len(data) - 1)]], np.int32(-1))
                matrix, counts = merged(ids, self.pairs)
                for i, row, count in zip(some.tolist(), matrix, counts.tolist()):
                    found[i] = row[:count]
            width *= 2
        for i in rest[sizes[rest] > WIDEST].tolist():
            found[i] = merged_long(self.pairs.single[data[starts[i] : ends[i]]], self.pairs)
        lengths = np.array([len(row) for row in found], np.int64)
        self.ids.add(np.concatenate(found), lengths)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids before each text and the end."""
        starts = pieces(data, offsets, self.classes)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys = mixed(range_hashes(prefix_hashes(SYMBOLS[data]), starts, ends) + (ends - starts).astype(np.uint64))
        keys[keys == 0] = 1
        place = self.known.find(keys)
        if (place < 0).any():
            new, first = np.unique(keys[place < 0], return_index=True)
            first = np.flatnonzero(place < 0)[first]
            if self.known.n + len(new) > self.limit:
                self.forget()
                new, first = np.unique(keys, return_index=True)
                if len(new) > self.limit:  # one part alone has more pieces than the table is meant for
                    self.known = Places(len(new))
            self.learn(data, starts[first], ends[first])
            self.known.insert(new)
            place = self.known.find(keys)
        ids, before = self.ids.gathered(place)
        return ids, before[np.searchsorted(starts, offsets)]


def parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Finer offsets, long texts being cut where a piece ends anyway, and the text that each part belongs to."""
    begins, owner = [offsets[:-1]], [np.arange(len(offsets) - 1)]
    for i in np.flatnonzero(np.diff(offsets) > limit):
        text = data[offsets[i] : offsets[i + 1]]
        safe = np.flatnonzero(((text[1:] == 32) | (text[1:] == 10)) & (text[:-1] > 32) & (text[:-1] < 127)) + 1
        if len(safe):
            chosen = np.unique(safe[np.minimum(np.searchsorted(safe, np.arange(limit, len(text), limit)), len(safe) - 1)])
            begins.append(offsets[i] + chosen)
            owner.append(np.full(len(chosen), i))
    begins, owner = np.concatenate(begins), np.concatenate(owner)
    order = np.lexsort((owner, begins))  # texts without bytes begin where the next one does
    return np.append(begins[order], offsets[-1]), owner[order]


def encoded_parts(column: pa.Array, memory: PieceIds, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, ids, bytes decoded from them) of every part of every text, in order."""
    data, offsets = utf8(column)
    offsets, owner = parts(data, offsets, limit)
    group = offsets[:-1] // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(owner)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        begin, end = offsets[a], offsets[b]
        ids, before = memory.encode(data[begin:end], offsets[a : b + 1] - begin)
        raw, sizes = memory.pairs.decode(ids)
        total = np.concatenate([[0], np.cumsum(sizes)])
        for k in range(b - a):
            i, j = before[k], before[k + 1]
            yield int(owner[a + k]), ids[i:j], raw[total[i] : total[j]]


def round_trip(
    df: DataFrame, ranks: str, text: str = "text", doc_id: str = "doc_id", limit: int = PART, memory: int = PIECES
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `df`: encoded, and decoded from the ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PieceIds(ranks, memory)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            ids_sums, decoded_sums = [""] * batch.num_rows, [""] * batch.num_rows
            ids_sum, decoded_sum, last = hashlib.sha256(), hashlib.sha256(), 0
            for i, ids, raw in encoded_parts(batch.column(1), known, limit):
                if i != last:
                    ids_sums[last], decoded_sums[last] = ids_sum.hexdigest(), decoded_sum.hexdigest()
                    ids_sum, decoded_sum, last = hashlib.sha256(), hashlib.sha256(), i
                ids_sum.update(ids.astype("<u4").tobytes())
                decoded_sum.update(raw.tobytes())
                counts[i] += len(ids)
            if batch.num_rows:
                ids_sums[last], decoded_sums[last] = ids_sum.hexdigest(), decoded_sum.hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids_sums, pa.string()), pa.array(decoded_sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(releasing(task), DIGESTS)


def encoded(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the ids of each text as a list column, which takes the place of a column of that name."""
    rows = df.select(packed(df), text_of(text).alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PieceIds(ranks)
        for batch in batches:
            lists: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for i, found, _ in encoded_parts(batch.column(1), known, PART):
                lists[i].append(found)
            sizes = np.array([sum(map(len, found)) for found in lists], np.int64)
            flat = [x for found in lists for x in found]
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            column = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), column.cast(pa.list_(pa.int32()))], ["carried", "ids"])

    return _unpacked(df, rows.mapInArrow(releasing(task), f"carried {kind}, ids array<int>"), "ids", ids)


def decoded(df: DataFrame, ranks: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text that each list of ids stands for."""
    rows = df.select(packed(df), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["carried"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pairs(ranks)
        for batch in batches:
            column = batch.column(1)
            raw, sizes = table.decode(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False))
            total = np.concatenate([[0], np.cumsum(sizes)])
            edges = total[np.asarray(column.offsets) - column.offsets[0].as_py()]
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["carried", "text"])

    return _unpacked(df, rows.mapInArrow(releasing(task), f"carried {kind}, text string"), "text", text)


def _unpacked(df: DataFrame, rows: DataFrame, made: str, name: str) -> DataFrame:
    kept = [F.col(f"carried.`{c}`").alias(c) for c in df.columns if c != name]
    return rows.select(*kept, F.col(made).alias(name))
