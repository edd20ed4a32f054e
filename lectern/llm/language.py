"""Language identification with unigrams over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; a text is the product of its words. The probabilities come
from expected counts: forward and backward sums, at first with equal probabilities, say how often each piece is used in
each distinct word of the texts learned from; counts are summed per task and language before they are shuffled.

Words are cut at white space and lower-cased; a character the vocabulary lacks is one unknown piece. The model has a
number per piece and language: its size is bounded by the vocabulary and the languages, not by the texts.

Defined results: `und` for texts that are NULL or have no letter, with score 0; without anything to learn from, every
text is `und`; ties go to the language that comes first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import mixed, powers, prefix_hashes, slices
from lectern.llm.data import held_out, text_of
from lectern.llm.wordtable import Places, Ragged, WordTable

UNKNOWN = 0
LONGEST = 16         # characters of a piece
LONGEST_WORD = 256   # characters after which a word is cut
SMOOTHING = 0.1
SPACE = "▁"  # the mark that begins a word in the vocabulary
NONE = "und"


@lru_cache(maxsize=1)
def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of a SentencePiece model without control and byte pieces; UNKNOWN is 0."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and piece == piece.lower():
            if len(piece) <= LONGEST:
                found[piece] = len(found) + 1
    return found


def window_keys(codes: np.ndarray, size: int, sums: np.ndarray) -> np.ndarray:
    """Hashes of each `size` code points in a row; `sums` are the hashes of all prefixes."""
    if size > len(codes):
        return np.empty(0, np.uint64)
    keys = mixed((sums[size:] - sums[:-size]) * powers(len(sums))[1][: len(codes) - size + 1] + np.uint64(size))
    keys[keys == 0] = 1
    return keys


def code_points(text: str) -> np.ndarray:
    return mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


@lru_cache(maxsize=1)
def piece_index(path: str) -> Places:
    """Place i is the piece i + 1 of the vocabulary."""
    known = vocabulary(path)
    found = Places(len(known))
    for piece in known:
        codes = code_points(piece)
        found.insert(window_keys(codes, len(codes), prefix_hashes(codes)))
    return found


class Lattices:
    """All segmentations of many words, passed through for all words in step.

    Words are marked at the start, and cut every LONGEST_WORD characters, after which each part is a word of its own;
    parts lie in order of descending length, so that those a step reaches come first.
    """

    def __init__(self, words: list[str], path: str):
        parts, owner = [], []
        for i, word in enumerate(words):
            marked = SPACE + word
            for at in range(0, len(marked), LONGEST_WORD):
                parts.append(marked[at : at + LONGEST_WORD])
                owner.append(i)
        sizes = np.array([len(part) for part in parts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        self.owner, self.sizes = np.array(owner, np.int64)[order], sizes[order]
        self.base = np.cumsum(self.sizes) - self.sizes
        self.node = self.base + np.arange(len(order))  # one node more than characters
        codes = code_points("".join([parts[i] for i in order]))
        sums = prefix_hashes(codes)
        left = np.repeat(self.base + self.sizes, self.sizes) - np.arange(len(codes))  # characters to the end of the part
        index = piece_index(path)
        self.hits: list[np.ndarray] = []
        for size in range(1, LONGEST + 1):
            hit = np.full(len(codes), -1, np.int32)
            at = np.flatnonzero(left >= size)
            hit[at] = index.find(window_keys(codes, size, sums)[at])
            self.hits.append(np.where(hit >= 0, hit + 1, UNKNOWN if size == 1 else -1))

    def sums(self, probabilities: np.ndarray, backward: bool = False) -> np.ndarray:
        """Per node and language the log of the sum over all segmentations of what lies before (behind) the node."""
        n, languages = len(self.sizes), probabilities.shape[1]
        out = np.zeros((int(self.sizes.sum()) + n, languages))
        ring = np.zeros((LONGEST, n, languages))
        ring[0] = 1.0
        scale = np.zeros((n, languages))
        for step in range(1, int(self.sizes[0]) + 1 if n else 1):
            live = int(np.searchsorted(-self.sizes, -step, side="right"))
            here = np.zeros((live, languages))
            at = self.sizes[:live] - step if backward else np.full(live, step)
            for size in range(1, min(LONGEST, step) + 1):
                piece = self.hits[size - 1][self.base[:live] + (at if backward else at - size)]
                some = np.flatnonzero(piece >= 0)
                here[some] += ring[(step - size) % LONGEST][some] * probabilities[piece[some]]
            ring[step % LONGEST][:live] = here
            out[self.node[:live] + at] = np.log(here) + scale[:live]
            if step % 4 == 0:  # the largest of the sums that are still needed becomes the unit
                unit = ring[:, :live].max(axis=0)
                ring[:, :live] /= unit
                scale[:live] += np.log(unit)
        return out

    def logarithms(self, probabilities: np.ndarray, words: int) -> np.ndarray:
        """Per word and language the log of its probability."""
        out = np.zeros((words, probabilities.shape[1]))
        np.add.at(out, self.owner, self.sums(probabilities)[self.node + self.sizes])
        return out

    def expectations(self, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, piece, expected uses), pieces being equally probable at first."""
        equal = np.full((pieces, 1), 1.0 / pieces)
        ahead, behind = self.sums(equal)[:, 0], self.sums(equal, backward=True)[:, 0]
        part = np.repeat(np.arange(len(self.sizes)), self.sizes)
        whole = ahead[self.node + self.sizes]
        found = []
        for size, hit in enumerate(self.hits, 1):
            at = np.flatnonzero(hit >= 0)
            node = at + part[at]
            share = np.exp(ahead[node] + behind[node + size] - whole[part[at]]) / pieces
            found.append((self.owner[part[at]], hit[at], share))
        return tuple(np.concatenate(columns) for columns in zip(*found))


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


class Expectations(WordTable):
    """Expected piece counts of words, made once for each distinct word a task meets."""

    def __init__(self, path: str):
        self.path, self.size = path, len(vocabulary(path)) + 1
        super().__init__()

    def forget(self) -> None:
        self.pieces, self.shares = Ragged(np.int32), Ragged(np.float32)

    def fresh(self, words: list[str]) -> None:
        word, piece, share = Lattices(words, self.path).expectations(self.size)
        order = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(words))
        self.pieces.add(piece[order].astype(np.int32), sizes)
        self.shares.add(share[order].astype(np.float32), sizes)


def counted(rows: DataFrame, path: str) -> DataFrame:
    """(lang, piece, times) over (lang, text) rows; the piece -1 counts texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Expectations(path)
        size = words.size
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                places, counts = words.places(lowered(part.column(1)))
                lang = part.column(0).dictionary_encode()
                of_text = lang.indices.to_numpy()
                of_word = np.repeat(of_text, np.diff(counts))
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    own = totals.setdefault(name, np.zeros(size + 1))
                    used, times = np.unique(places[of_word == k], return_counts=True)
                    found, before = words.pieces.gathered(used)
                    weight = words.shares.gathered(used)[0] * np.repeat(times, np.diff(before))
                    own[:size] += np.bincount(found, weight, minlength=size)
                    own[size] += (of_text == k).sum()
        for name, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * len(some), pa.string()),
                    "piece": pa.array(np.where(some == size, -1, some), pa.int32()),
                    "times": pa.array(own[some]),
                }
            )

    sums = rows.select("lang", "text").mapInArrow(task, "lang string, piece int, times double")
    return sums.groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def fitted(rows: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece probabilities, log shares of the languages), from one row per piece and language."""
    found = counted(rows, path).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    times = np.zeros((len(vocabulary(path)) + 2, len(languages)))
    place = found["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    times[found["piece"].to_numpy(np.int64), place] = found["times"].to_numpy()
    texts, times = times[-1], times[:-1] + SMOOTHING
    return languages, times / times.sum(axis=0), np.log(np.maximum(texts, 1.0) / max(texts.sum(), 1.0))


class Logarithms(WordTable):
    """Per distinct word of a task the log of its probability in each language."""

    def __init__(self, path: str, probabilities: np.ndarray):
        self.path, self.probabilities = path, probabilities
        super().__init__()

    def forget(self) -> None:
        self.logs = Ragged(np.float64)

    def fresh(self, words: list[str]) -> None:
        values = Lattices(words, self.path).logarithms(self.probabilities, len(words))
        self.logs.add(values.ravel(), np.full(len(words), self.probabilities.shape[1], np.int64))


def scored(df: DataFrame, learned: tuple[list[str], np.ndarray, np.ndarray], path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of (doc_id, held_out, lettered, text) rows."""
    shared = df.sparkSession.sparkContext.broadcast(learned)  # a number per piece and language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probabilities, prior = shared.value
        every = len(languages)
        table = Logarithms(path, probabilities)
        names = pa.array([*languages, NONE])
        for batch in batches:
            for part in slices(batch, "text"):
                places, counts = table.places(lowered(part.column(3)))
                values = table.logs.gathered(places)[0].reshape(-1, every)
                sums = np.zeros((len(values) + 1, every))
                np.cumsum(values, axis=0, out=sums[1:])
                total = sums[counts[1:]] - sums[counts[:-1]] + prior
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                lettered = part.column(2).to_numpy(zero_copy_only=False)
                best = np.where(lettered, best, every)
                score = np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)
                columns = [part.column(0), part.column(1), names.take(pa.array(best)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return df.select("doc_id", "held_out", "lettered", "text").mapInArrow(task, schema)


def identified(
    df: DataFrame, path: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", apart: Column | None = None
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `df`; learned from the rows that `apart` does not hold out."""
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (held_out(doc_id) if apart is None else apart).alias("held_out"),
        F.coalesce(text_of(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        text_of(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    learned = fitted(rows.where("not held_out and lang is not null"), path)
    if not learned[0]:
        return rows.select("doc_id", "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    return scored(rows, learned, path)
