"""BPE encoding and decoding with tree concatenation.

The merges are applied here; the tokenizer file gives the vocabulary, the merges, the normaliser and the pattern that
cuts a text into pieces. A long piece that nothing splits is cut into halves again and again; the halves are encoded on their
own and joined: the symbols around the join are encoded again in a window that grows until its first and last tokens
are those of the two sides. Every pair of neighbours is then one that encodes to itself, which makes the whole the
encoding of the whole, since each token has one merge only.

Texts with very long unsplit stretches become rows of segments, which tasks encode in parallel and join by document.
All other texts are encoded where they lie, each distinct word once for as long as it is remembered.

Defined results: NULL text encodes as empty; rows that repeat are encoded each on its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import LIGHT_SLICE_BYTES, releasing, slices
from lectern.llm.data import text_of
from lectern.llm.tokenizer import ODD, loaded
from lectern.llm.wordtable import Ragged, WordTable

LEAF = 128          # symbols that are merged in one go
WINDOW = 4          # tokens on either side of a join at first
LONG = 1 << 16      # code points without white space from which a document is cut into segments
SEGMENT = 1 << 14   # bytes of a segment
WORDS = 1 << 18     # distinct words a task remembers


class Merges:
    """Vocabulary and merges of a tokenizer file, on numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.whole = [self.ids[a + b] for a, b in pairs]
        self.parts = {whole: (self.ids[a], self.ids[b]) for whole, (a, b) in zip(self.whole, pairs)}
        self.added = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.tokens = {i: token for token, i in {**self.ids, **self.added}.items()}
        found = "|".join(re.escape(token) for token in sorted(self.added, key=len, reverse=True))
        self.special = re.compile(f"({found})") if found else None
        library = loaded(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.spelled: dict[int, list[int]] = {}

    def symbols(self, piece: str, ends: bool = True) -> list[int]:
        if not piece:
            return []
        out = [self.ids[ch] for ch in piece[:-1]]
        out.append(self.ids[piece[-1] + self.end if ends else piece[-1]])
        return out

    def spell(self, token: int) -> list[int]:
        """The symbols a token was merged from."""
        known = self.spelled.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = [token] if pair is None else self.spell(pair[0]) + self.spell(pair[1])
            self.spelled[token] = known
        return known

    def merge(self, symbols: list[int]) -> list[int]:
        """The merges in order of rank, leftmost first, one after the other."""
        rank, whole_of = self.rank, self.whole
        if len(symbols) <= 32:
            out, none = list(symbols), len(whole_of)
            ranks = [rank.get(pair, none) for pair in zip(out, out[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                out[i : i + 2] = [whole_of[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((out[i - 1], out[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((out[i], out[i + 1]), none)
            return out
        out, n = list(symbols), len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found, i) for i in range(n - 1) if (found := rank.get((out[i], out[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            order, i = heapq.heappop(heap)
            j = right[i] if out[i] >= 0 else n
            if j >= n or rank.get((out[i], out[j])) != order:
                continue
            whole = whole_of[order]
            out[i], out[j] = whole, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (found := rank.get((whole, out[right[i]]))) is not None:
                    heapq.heappush(heap, (found, i))
            if left[i] >= 0 and (found := rank.get((out[left[i]], whole))) is not None:
                heapq.heappush(heap, (found, left[i]))
        return [token for token in out if token >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two stretches together, from the encodings of each."""
        if not left or not right:
            return left + right
        width = WINDOW
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            symbols = [s for token in left[a:] + right[:b] for s in self.spell(token)]
            window = self.merge(symbols)
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Neighbours joined in pairs, then the pairs, up to the whole."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0] if parts else []

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        leaves = [self.merge(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        return self.joined(leaves)

    def pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id of an added token, "") or (None, piece), in order."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                yield self.added[part], ""
            elif part:
                for piece, _ in self.cut(self.normalise(part)):
                    yield None, piece

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for known, piece in self.pieces(text):
            out += [known] if known is not None else self.encode_symbols(self.symbols(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the tokens come with one space between them."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


class Words(WordTable):
    """Per word the number of ids, the ids as decimals and the decoded tokens, each with a space behind it."""

    def __init__(self, path: str):
        self.merges = merges(path)
        super().__init__(WORDS)

    def forget(self) -> None:
        self.sizes, self.decimals, self.decoded = Ragged(np.int64), Ragged(np.uint8), Ragged(np.uint8)

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ordinary words are normalised and cut in one line, from which each takes its pieces."""
        codec = self.merges
        ids: list[list[int]] = [codec.encode(word) if ODD.search(word) else [] for word in words]
        ordinary = [i for i, word in enumerate(words) if not ODD.search(word)]
        line = codec.normalise(" ".join([words[i] for i in ordinary]))
        at, end = 0, line.find(" ")
        for piece, (start, _) in codec.cut(line):
            while 0 <= end <= start:
                at, end = at + 1, line.find(" ", end + 1)
            ids[ordinary[at]] += codec.encode_symbols(codec.symbols(piece))
        return ids

    def fresh(self, words: list[str]) -> None:
        ids = self.ids_of(words)
        self.sizes.add(np.array([len(own) for own in ids]), np.ones(len(ids), np.int64))
        tokens = self.merges.tokens
        for spelled, to in ((str, self.decimals), (tokens.__getitem__, self.decoded)):
            lines = ["".join([spelled(i) + " " for i in own]).encode() for own in ids]
            to.add(np.frombuffer(b"".join(lines), np.uint8), np.array([len(line) for line in lines]))

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, SHA-256 of the decimal ids and SHA-256 of the decoded text, of each text."""
        places, counts = self.places(texts)
        sizes, _ = self.sizes.gathered(places)
        n = np.diff(np.concatenate([[0], np.cumsum(sizes)])[counts])
        hashes = []
        for strings in (self.decimals, self.decoded):
            found, before = strings.gathered(places)
            line, cuts = memoryview(found), before[counts].tolist()
            # The space behind the last token does not belong to the line.
            hashes.append([hashlib.sha256(line[a : max(b - 1, a)]).hexdigest() for a, b in zip(cuts, cuts[1:])])
        return n, *hashes


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(rows: DataFrame, tokenizer: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                n, ids, decoded = words.digests(part.column(1))
                columns = [part.column(0), pa.array(n), pa.array(ids), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.select("doc_id", "text").mapInArrow(releasing(task), DIGESTS)


SEGMENTS = "doc_id long, row long, item long, part int, ends boolean, payload string"


def segments(rows: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """The pieces of each text in order; long ones in parts of `size` bytes, short ones gathered up to that size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = merges(tokenizer)
        for batch in batches:
            for doc_id, row, text in zip(*(column.to_pylist() for column in batch.columns)):
                out: list[tuple] = []
                for item, (known, piece) in enumerate(codec.pieces(text)):
                    if known is not None:
                        out.append((doc_id, row, item, -1, True, str(known)))
                    for part, at in enumerate(range(0, len(piece), size)):
                        out.append((doc_id, row, item, part, at + size >= len(piece), piece[at : at + size]))
                    if len(out) >= 1_000:
                        yield table(out)
                        out = []
                if out:
                    yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "row", "item", "part", "ends", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("doc_id", "row", "text").mapInArrow(releasing(task), SEGMENTS)


def encoded_segments(rows: DataFrame, tokenizer: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = merges(tokenizer)
        for batch in batches:
            found = [
                [int(payload)] if part < 0 else codec.encode_symbols(codec.symbols(payload, ends))
                for part, ends, payload in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))
            ]
            columns = [*batch.columns[:4], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "item", "part", "ids"])

    return rows.mapInArrow(releasing(task), "doc_id long, row long, item long, part int, ids array<int>")


def joined_segments(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document from the encoded parts of its pieces."""

    def group(batches: pa.Table) -> pa.Table:
        codec = merges(tokenizer)
        ordered = batches.sort_by([("item", "ascending"), ("part", "ascending")])
        ids: list[int] = []
        parts: list[list[int]] = []
        last = None
        for item, values in zip(ordered["item"].to_pylist(), ordered["ids"].to_pylist()):
            if item != last:
                ids += codec.joined(parts)
                parts, last = [], item
            parts.append(values)
        ids += codec.joined(parts)
        return pa.table(
            {
                "doc_id": ordered["doc_id"].slice(0, 1),
                "n_tokens": pa.array([len(ids)], pa.int64()),
                "ids_sha256": [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()],
                "decoded_sha256": [hashlib.sha256(codec.decode(ids).encode()).hexdigest()],
            }
        )

    return rows.groupBy("row").applyInArrow(group, DIGESTS)


def round_trip(
    df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", long: int = LONG, segment: int = SEGMENT
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `df`."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    unsplit = (F.length("text") >= long) & F.col("text").rlike(rf"[^\s]{{{long}}}")
    near = digested(rows.where(~unsplit), tokenizer)
    far = rows.where(unsplit).withColumn("row", F.monotonically_increasing_id())
    cut = segments(far, tokenizer, segment).repartition("row", "item", "part")
    return near.unionByName(joined_segments(encoded_segments(cut, tokenizer), tokenizer))
