"""Words of texts as places in a table that remembers what each distinct word came to.

A word is known by the 64-bit hash of its bytes, so a batch is looked up without making strings; only words that are
new to the task become strings, and are handed on once. The table forgets all words when it is full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lectern.llm.arrays import FOLDED, SEPARATOR, SYMBOLS, mixed, prefix_hashes, range_hashes, utf8

LIMIT = 1 << 19
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?")] = True
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LATIN = np.zeros(256, bool)  # second bytes of the letters that begin with C3
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def cut(texts: pa.Array, at_marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, number of words before each text and the end).

    Words end at white space (9 to 13, 32) and, `at_marks`, where one of .,;:!? follows a letter or digit. Letters A to Z become
    lower case in texts whose code points are all below 256 and that have no "<|": elsewhere, composition of
    characters or marked tokens could depend on the case.
    """
    data, offsets = utf8(texts)
    n = len(data)
    opened = np.zeros(n, bool)
    opened[:-1] = (data[:-1] == 60) & (data[1:] == 124)
    simple = per_text((data >= 0xC4) | opened, offsets) == 0
    data = np.where(np.repeat(simple, np.diff(offsets)), FOLDED[data], data)
    inside = ~SEPARATOR[data]
    letter = PLAIN[data]
    letter[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[1:n] |= ~inside[:-1]
    if at_marks:
        first[1:n] |= MARKS[data[1:]] & letter[:-1]
    last = first[1:].copy()
    last[:-1] |= ~inside[1:]
    last[-1:] = True
    starts = np.flatnonzero(inside & first[:n])
    ends = np.flatnonzero(inside & last) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class Ragged:
    """Lists of values one after the other, by place."""

    def __init__(self, dtype):
        self.values, self.ends, self.n = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.ends[self.n] + np.cumsum(sizes)
        while len(self.ends) < self.n + 1 + len(sizes):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.values) < ends[-1]:
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[self.ends[self.n] : ends[-1]] = values
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = ends
        self.n += len(sizes)

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places one after the other, and the number of values before each place and the end."""
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        before = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        where = np.repeat(starts - before[:-1], sizes)
        where += np.arange(len(where))
        return self.values[where], before


class Places:
    """Places of 64-bit keys, an open-addressing table that is asked for many keys at a time."""

    def __init__(self, limit: int):
        self.mask = np.uint64((1 << (2 * limit - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.slots = np.zeros(int(self.mask) + 1, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where a key is new."""
        out = np.full(len(keys), -1, np.int64)
        slot, open_ = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.slots[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + 1) & int(self.mask)
        return out

    def insert(self, keys: np.ndarray) -> None:
        """The next places for keys that are new, distinct and not 0."""
        place = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.slots[slot[won]] = place[won]
            keys, place, slot = keys[~won], place[~won], (slot[~won] + 1) & int(self.mask)


class WordTable:
    """`fresh(words)` is called with new words, which get the next places in that order; `forget()` before all places
    are given anew. Both come from a subclass: a table that held functions of its owner would be a cycle, which a
    worker keeps long after the task."""

    at_marks = True  # whether words end at marks, too

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.known = Places(limit)
        self.forget()

    def fresh(self, words: list[str]) -> None:
        raise TypeError("what a word comes to is for the subclass to say")

    def forget(self) -> None:
        raise TypeError("what to forget is for the subclass to say")

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of every word of every text, and the number of words before each text and the end."""
        data, starts, ends, counts = cut(texts, self.at_marks)
        if not len(starts):
            return np.empty(0, np.int64), counts
        keys = mixed(range_hashes(prefix_hashes(SYMBOLS[data]), starts, ends) + (ends - starts).astype(np.uint64))
        keys[keys == 0] = 1
        found = self.known.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.known.n + len(new) > self.limit and self.known.n:
                self.forget()
                self.known = Places(self.limit)
                new, first = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            if len(new) > self.limit:  # one text alone has more words than the table is meant for
                self.known = Places(len(new))
            raw, at = data.tobytes(), missing[first]
            order = np.argsort(at, kind="stable")
            new, at = new[order], at[order]
            self.fresh([raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.known.insert(new)
            found[missing] = self.known.find(keys[missing])
        return found, counts
