"""Texts of Arrow batches as numpy arrays: bounded slices, words, shingles and rolling hashes.

All hashes are 64-bit polynomials over mixed symbols with wrap-around arithmetic. They route and pre-select; two
different short strings share a value with a chance of about 2 to the power of -64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20
LIGHT_SLICE_BYTES = 1 << 18  # where workers of several stages share an executor's memory

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
FOLDED_SYMBOLS = SYMBOLS[FOLDED]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n-1, modulo 2^64; kept, and made anew where more are asked for."""
    if len(_powers.get("up", ())) < n:
        size = max(n, LIGHT_SLICE_BYTES) + (max(n, LIGHT_SLICE_BYTES) >> 3)
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            series = np.full(size, factor, np.uint64)
            series[0] = 1
            _powers[name] = np.cumprod(series)
    return _powers["up"], _powers["down"]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of 64-bit `symbols`, the empty one first."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def range_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), the same wherever a stretch begins."""
    _, down = powers(len(prefixes))
    return (prefixes[ends] - prefixes[starts]) * down[starts]


Batches = Iterator[pa.RecordBatch]


def releasing(task: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`task`, after which Arrow and the C library give back what they hold unused: the worker lives on beside the next
    stage's."""

    def run(batches: Batches) -> Batches:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about `limit` bytes of text at a time and one whole text at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    part = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without NULLs, one text after the other, and where each begins and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are stretches without the characters 9 to 13 and 32: their starts, their ends, and the number of words
    before each text and before the end."""
    n = len(data)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words after lower-casing A to Z only."""
    prefixes = prefix_hashes(FOLDED_SYMBOLS[data])
    return mixed(range_hashes(prefixes, starts, ends) + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each text, and the number of runs before each text and the end.

    `counts` are the numbers of words before each text. A text with fewer words has its whole sequence as one run, a
    text without words none.
    """
    n = len(hashes)
    up, _ = powers(size + 1)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        total += hashes[j : n - size + 1 + j] * up[j] if n >= size else np.empty(0, np.uint64)
    total = mixed(total)
    per_text = np.diff(counts)
    runs = np.where(per_text >= size, per_text - size + 1, np.minimum(per_text, 1))
    out_counts = np.zeros(len(counts), np.int64)
    np.cumsum(runs, out=out_counts[1:])
    first = np.repeat(counts[:-1] - out_counts[:-1], runs)
    where = np.arange(out_counts[-1]) + first
    out = np.zeros(len(where), np.uint64)
    full = np.repeat(per_text >= size, runs)
    out[full] = total[where[full]]
    for text in np.flatnonzero((per_text > 0) & (per_text < size)):
        own = hashes[counts[text] : counts[text + 1]]
        value = (own * up[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        out[out_counts[text]] = mixed(np.array([value], np.uint64))[0]
    return out, out_counts


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
