"""Words of a corpus and the spelling they are most likely variants of, by a trie of letter counts.

Words are counted in one pass over the texts: stretches of letters are found in the bytes, each distinct one is kept once by a
task, and the checksum of (document, word) is put together from the checksum of its two parts by table look-ups.

Two words that differ by one inserted, deleted or replaced character have letter counts that differ by one surplus and one
deficit at most. Letters fall into GROUPS groups (code point modulo GROUPS); the vector of a word is its length and its count
in each group. Words are dealt to shards by the first levels of that vector, which are the top of the trie; a word asks
in its own shard and in those one surplus or deficit away, in such an order that a pair meets once. Inside a
shard the other levels are a trie over sorted vectors: a search goes depth first, blocks of open nodes at a time, spends its
surplus and its deficit on the way, and verifies the words of the leaves it reaches. Shards with many words or many
questions are cut into pieces that meet each other, so no task holds an unbounded group.

Forms point to words at least twice as frequent, so following them ends; pointers are doubled until none moves.

Defined results: NULL text has no words; a NULL id counts as the empty text before the colon; rows that repeat count each time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import FOLDED, SYMBOLS, as_long, mixed, prefix_hashes, range_hashes, releasing, utf8
from lectern.llm.byte_bpe import PART, parts
from lectern.llm.data import partitions, text_of
from lectern.llm.wordtable import Places
from lectern.operators.skew import join_checked
from lectern.sources.storage import written

LEAST_CHARS, LEAST_TIMES = 5, 3
ONE_IN = 97               # one in so many occurrences loses a character
WORDS = 1 << 18           # distinct stretches a task remembers
TABLED = 48               # bytes of a stretch up to which checksums are put together by tables

GROUPS = 12               # groups of letters
TOP = 3                   # groups that decide the shard, after the length
HELD = 50_000             # words of a shard that one task holds
ASKED = 250_000           # questions to a shard that one task holds
OPEN = 1 << 16            # open nodes that go a level deeper at a time
WIDTH = 64                # characters of words that are compared as matrices


# --- words ------------------------------------------------------------------------------------------------


def shift_tables() -> np.ndarray:
    """What each byte of a CRC-32 becomes behind 0 .. TABLED further bytes of zeros: [length, byte place, value]."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((TABLED + 1, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for length in range(1, TABLED + 1):
        out[length] = (out[length - 1] >> np.uint32(8)) ^ step[out[length - 1] & 255]
    return out


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of characters of the stretches of A-Z, a-z and U+00C0 to U+00FF; the latter are all
    characters whose first byte is C3."""
    lead = data == 0xC3
    inside = lead | ((FOLDED[data] >= 97) & (FOLDED[data] <= 122))
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    twice = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, ends - starts - (twice[ends] - twice[starts])


class Counts:
    """How often each word occurs in a task, until it is handed on."""

    def __init__(self, limit: int):
        self.limit, self.shift = limit, shift_tables().reshape(-1)
        self.forget()

    def forget(self) -> None:
        self.known = Places(self.limit)
        self.words: list[bytes] = []
        self.crc, self.chars, self.times = (np.zeros(self.limit + 1, np.int64) for _ in range(3))
        self.changed: Counter = Counter()

    def full(self, more: int) -> bool:
        return self.known.n + more > self.limit or len(self.changed) > self.limit

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.words), 10_000):
            times = self.times[k : k + 10_000][: len(self.words) - k]
            words = [w.decode() for w, n in zip(self.words[k : k + 10_000], times.tolist()) if n]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(times[times > 0])})
        changed = list(self.changed.items())
        for k in range(0, len(changed), 10_000):
            words, times = zip(*changed[k : k + 10_000])
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(times, pa.int64())})
        self.forget()

    def add(self, data: np.ndarray, offsets: np.ndarray, documents: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the words of texts; `documents` are the checksums of what stands before a word of each."""
        starts, ends, chars = stretches(data, offsets)
        enough = chars >= LEAST_CHARS
        starts, ends, chars = starts[enough], ends[enough], chars[enough]
        if not len(starts):
            return
        folded = FOLDED[data]
        sizes = ends - starts
        keys = mixed(range_hashes(prefix_hashes(SYMBOLS[folded]), starts, ends) + sizes.astype(np.uint64))
        keys[keys == 0] = 1
        place = self.known.find(keys)
        if (place < 0).any():
            new, first = np.unique(keys[place < 0], return_index=True)
            first = np.flatnonzero(place < 0)[first]
            if self.full(len(new)):
                yield from self.handed_on()
                new, first = np.unique(keys, return_index=True)
                if len(new) > self.limit:  # one part alone has more words than the table is meant for
                    self.known = Places(len(new))
                    self.crc, self.chars, self.times = (np.zeros(len(new) + 1, np.int64) for _ in range(3))
            raw = folded.tobytes()
            found = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            n = self.known.n
            self.crc[n : n + len(new)] = [zlib.crc32(word) for word in found]
            self.chars[n : n + len(new)] = chars[first]
            self.words += found
            self.known.insert(new)
            place = self.known.find(keys)
        before = documents[np.searchsorted(offsets, starts, side="right") - 1].astype(np.int64)
        near = np.minimum(sizes, TABLED)
        whole = self.crc[place]
        for byte in range(4):
            whole ^= self.shift[near * 1024 + byte * 256 + ((before >> (8 * byte)) & 255)].astype(np.int64)
        for i in np.flatnonzero(sizes > TABLED):
            whole[i] = zlib.crc32(self.words[place[i]], int(before[i]))
        struck = whole % ONE_IN == 0
        self.times[: self.known.n] += np.bincount(place[~struck], minlength=self.known.n)
        for i, at in zip(place[struck].tolist(), (whole % chars)[struck].tolist()):
            word = self.words[i].decode()
            if len(word) > LEAST_CHARS:
                self.changed[word[:at] + word[at + 1 :]] += 1


def vocabulary(df: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = WORDS) -> DataFrame:
    """(word, n): the words of at least LEAST_CHARS characters and LEAST_TIMES occurrences in all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(limit)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.int64)
            offsets, owner = parts(data, offsets, PART)
            group = offsets[:-1] // PART
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(owner)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    begin, end = offsets[a], offsets[b]
                    yield from counts.add(data[begin:end], offsets[a : b + 1] - begin, before[owner[a:b]])
        yield from counts.handed_on()

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_of(text).alias("text"))
    counted = rows.mapInArrow(releasing(task), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


# --- pairs ------------------------------------------------------------------------------------------------


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and where each begins and the last ends."""
    data, offsets = utf8(words)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int64)
    wide = points >= 0xC0
    points[wide] = ((points[wide] & 0x1F) << 6) | (data[at[wide] + 1] & 0x3F)
    return points, np.searchsorted(at, offsets)


def vectors(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many characters of each group a word has, words x GROUPS."""
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(word * GROUPS + points % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS)


def shard(lengths: np.ndarray, top: np.ndarray) -> np.ndarray:
    key = mixed(lengths.astype(np.uint64) + np.uint64(1))
    for column in top.T:
        key = mixed(key + column.astype(np.uint64) + np.uint64(1))
    return key


def changes() -> list[tuple[tuple[int, ...], int, int, int]]:
    """(change of the top counts, change of the length, surplus left, deficit left) of all shards that a word asks.

    Of two shards with words of the same length, only the one with the first smaller count asks the other.
    """
    out = []
    for more in range(-1, TOP):
        for less in range(-1, TOP):
            if more == less and more >= 0:
                continue
            change = tuple((i == more) - (i == less) for i in range(TOP))
            if less < 0:
                out.append((change, 1, int(more < 0), 0))
            if change >= (0,) * TOP:
                out.append((change, 0, int(more < 0), int(less < 0)))
    return out


def dealt(words: DataFrame) -> DataFrame:
    """Every word in its shard (surplus -1), and once for each shard it asks, with what it has left to spend."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, offsets = spelled(batch.column(0))
            counts, lengths = vectors(points, offsets), np.diff(offsets)
            top = counts[:, :TOP]

            def rows(chosen: np.ndarray, key: np.ndarray, own: bool, surplus: int, deficit: int) -> pa.RecordBatch:
                some = batch.filter(pa.array(chosen))
                n = some.num_rows
                columns = [pa.array(as_long(key[chosen])), some.column(0), some.column(1)]
                columns += [pa.array(np.full(n, x, np.int8)) for x in (surplus, deficit)]
                columns.append(pa.array(np.full(n, own)))
                return pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "surplus", "deficit", "own"])

            yield rows(np.ones(len(lengths), bool), shard(lengths, top), True, -1, -1)
            for change, longer, surplus, deficit in changes():
                asked = top + np.array(change)
                chosen = (asked >= 0).all(axis=1)
                yield rows(chosen, shard(lengths + longer, np.maximum(asked, 0)), not longer and not any(change), surplus, deficit)

    schema = "key long, word string, n long, surplus byte, deficit byte, own boolean"
    return words.select("word", "n").mapInArrow(releasing(task), schema)


class Trie:
    """Words of some shards in the order of their vectors; a node is a range of them that agrees down to a level."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = [keys.view(np.uint64), *counts[:, TOP:].T]
        self.order = np.lexsort(levels[::-1])
        self.depth = len(levels) - 1
        node = np.zeros(len(keys), np.int64)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        for level in levels:
            value = level[self.order]
            edge = np.append(True, (node[1:] != node[:-1]) | (value[1:] != value[:-1]))[: len(keys)]
            first = np.flatnonzero(edge)
            self.children.append((node[first], value[first]))
            node = np.cumsum(edge) - 1
            self.first = np.append(first, len(keys))

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """The node of each shard, -1 where no word is in it."""
        _, values = self.children[0]
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        return np.where(values[at] == keys, at, -1)

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child with that count of each node, -1 where there is none."""
        parent, value = self.children[level + 1]
        most = int(value.max()) + 2
        wanted, there = node * most + np.minimum(count, most - 1), parent * most + value
        at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        return np.where((there[at] == wanted) & (count >= 0), at, -1)

    def search(self, keys: np.ndarray, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, word) pairs whose vectors are within what the question may spend, block by block, depth first."""
        node = self.roots(keys.view(np.uint64))
        asked = np.flatnonzero(node >= 0)
        stack = [(0, asked[k : k + OPEN], node[asked[k : k + OPEN]], surplus[asked[k : k + OPEN]], deficit[asked[k : k + OPEN]])
                 for k in range(0, len(asked), OPEN)]
        while stack:
            level, who, node, up, down = stack.pop()
            if level == self.depth:
                size = self.first[node + 1] - self.first[node]
                start = np.cumsum(size) - size
                place = np.repeat(self.first[node] - start, size) + np.arange(size.sum())
                yield np.repeat(who, size), self.order[place]
                continue
            count = counts[who, TOP + level]
            found = []
            for change in (0, 1, -1):
                may = np.ones(len(who), bool) if not change else (up if change > 0 else down) > 0
                below = self.child(level, node[may], count[may] + change)
                real = below >= 0
                found.append((who[may][real], below[real], (up - (change > 0))[may][real], (down - (change < 0))[may][real]))
            who, node, up, down = (np.concatenate(x) for x in zip(*found))
            for k in range(0, len(who), OPEN):
                stack.append((level + 1, who[k : k + OPEN], node[k : k + OPEN], up[k : k + OPEN], down[k : k + OPEN]))


def one_apart(short: str, long: str) -> bool:
    """Whether one character of `long` inserted or replaced makes it of `short`, which is not longer."""
    same = next((i for i, (a, b) in enumerate(zip(short, long)) if a != b), len(short))
    return short != long and short[same + (len(short) == len(long)) :] == long[same + 1 :]


def verified(a: np.ndarray, b: np.ndarray, spelling: tuple[np.ndarray, np.ndarray], words: pa.Array) -> np.ndarray:
    """Which pairs of words differ by one character; `b` is as long as `a` or longer by one."""
    points, offsets = spelling
    size, longer = np.diff(offsets)[a], np.diff(offsets)[b] - np.diff(offsets)[a]
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(size < WIDTH)
    padded = np.concatenate([points, np.zeros(WIDTH + 1, np.int64)])
    for k in range(0, len(near), OPEN // 4):
        some = near[k : k + OPEN // 4]
        width = int(size[some].max())
        column = np.arange(width)
        inside = column < size[some, None]
        left = padded[offsets[a[some], None] + column]
        start = offsets[b[some], None] + column
        head = (left == padded[start]) | ~inside
        tail = (left == padded[start + longer[some, None]]) | ~inside
        heads = np.where(head.all(axis=1), size[some], head.argmin(axis=1))
        tails = np.where(tail.all(axis=1), size[some], size[some] - (width - tail[:, ::-1].argmin(axis=1)))
        out[some] = np.where(longer[some] == 1, heads + tails >= size[some], heads + tails == size[some] - 1)
    for i in np.flatnonzero(size >= WIDTH):
        out[i] = one_apart(words[int(a[i])].as_py(), words[int(b[i])].as_py())
    return out


def pairs(words: DataFrame, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """(word, other, other_n) for all pairs of words that differ by one character, in both directions."""
    spark = words.sparkSession
    rows = dealt(words)
    isasked = F.col("surplus") >= 0
    sizes = rows.groupBy("key").agg(
        F.ceil(F.sum((~isasked).cast("long")) / held).alias("held_in"), F.ceil(F.sum(isasked.cast("long")) / asked).alias("asked_in")
    )
    # Shards that are cut: no more of them than words / `held` and questions / `asked`.
    cut = written(sizes.where("held_in > 0 and (held_in > 1 or asked_in > 1)"), "cut-shards")
    rows = join_checked(rows, cut, ["key"], "left")
    held_in, asked_in = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("held_in", "asked_in"))
    # A word lies in one piece of its kind and meets every piece of the other kind.
    mine = F.pmod(F.xxhash64("word"), F.when(isasked, asked_in).otherwise(held_in))
    theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.when(isasked, held_in).otherwise(asked_in) - 1))
    rows = rows.select("*", mine.alias("mine"), theirs.alias("theirs"))
    piece = F.xxhash64(
        "key", F.when(isasked, F.col("theirs")).otherwise(F.col("mine")), F.when(isasked, F.col("mine")).otherwise(F.col("theirs"))
    )
    buckets = max(partitions(spark), words.count() // held * 4)
    rows = rows.select(
        F.pmod(piece, F.lit(buckets)).alias("bucket"), piece.alias("key"), "word", "n", "surplus", "deficit", "own"
    )

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words_ = table["word"].chunk(0) if table["word"].num_chunks else pa.array([], pa.string())
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        surplus, deficit, own_ = (table[c].to_numpy(zero_copy_only=False) for c in ("surplus", "deficit", "own"))
        spelling = spelled(words_)
        counts = vectors(*spelling)
        there, asks = np.flatnonzero(surplus < 0), np.flatnonzero(surplus >= 0)
        found = []
        if len(there) and len(asks):
            trie = Trie(key[there], counts[there])
            for a, b in trie.search(key[asks], counts[asks], surplus[asks], deficit[asks]):
                a, b = asks[a], there[b]
                real = verified(a, b, spelling, words_)
                a, b = a[real], b[real]
                # In its own shard a word meets the other from either side.
                twice = np.flatnonzero(own_[a])
                again = [i for i in twice.tolist() if words_[int(a[i])].as_py() > words_[int(b[i])].as_py()]
                keep = np.ones(len(a), bool)
                keep[again] = False
                found.append((a[keep], b[keep]))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        both, others = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.table({"word": words_.take(both), "other": words_.take(others), "other_n": pa.array(n[np.concatenate([b, a])])})

    return rows.groupBy("bucket").applyInArrow(lambda table: group(table.drop_columns(["bucket"])), "word string, other string, other_n long")


# --- forms ------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in as many steps as the logarithm of the longest way."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onwards = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = join_checked(reached, onwards, ["root"], "left")
        reached = written(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = WORDS, held: int = HELD, asked: int = ASKED
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = written(vocabulary(df, text, doc_id, limit), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = pairs(words, held, asked).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= 2 * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    known = written(known, "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
