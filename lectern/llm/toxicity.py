"""Toxicity behind noise: words are restored by a noisy channel before they are scored.

A character trigram model is counted over all texts of the corpus. A word that shows traces of disguise (digits or signs among
letters, letters three times in a row, single letters set apart, a letter doubled that the corpus has more often once) becomes a lattice: a sign may stand for a letter, be
a boundary or be noise, a repeated letter may be one. The Viterbi path under the character model and the costs of the
channel is the restored word. Other words restore to themselves.

Evidence is a restored word, or its first letters where a word may have other endings, for which the share of toxic
documents among the labelled ones is high at the lower end of its confidence interval. A logistic regression weighs the
evidence, so that what only goes along with stronger evidence counts little. Labels are learned from at most SAMPLE
labelled rows, the first in order of a hash of the id, from every feature that passes; the character model (all its
triples, sorted arrays sent in chunks), restoring and scoring cover all rows and whole texts.

Defined results: a text that is NULL, empty or without evidence has the score of no evidence; labels that are NULL are
left out, ones that contradict each other count each; without toxic labels every score is near 0.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import LIGHT_SLICE_BYTES, releasing, slices
from lectern.llm.data import held_out, text_of
from lectern.llm.rows import numbered, without
from lectern.llm.wordtable import Ragged, WordTable
from lectern.sources.storage import written

SAMPLE = 40_000          # labelled rows that are learned from
CHUNK = 1 << 18          # triples of the character model that are sent at a time
DEVIATIONS = 2.5         # width of the confidence interval
LEAST = 0.3
RIDGE = 0.05             # weight of the squares of the weights
STEPS = 400
BEGINNINGS = (4, 5, 6)   # letters
REMEMBERED = 1 << 18     # costs that a task remembers
RUN = 3                  # single letters in a row that may be a word
SETTLED = 4096           # characters of a lattice after which what all open paths share is settled

# Letters that signs may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
STAND_IN, REPEATED, NOISE = 1.5, 1.0, 1.0  # costs of the channel, as negative logs
EDGE = "#"
EDGES = (EDGE, EDGE)
LETTERS = re.compile(r"[^\W\d_]+")
MARKS = ".,;:!?"
PIECES = re.compile(r"[^.,;:?!]+|!")
DOUBLED = re.compile(r"([^\W\d_])\1")
SUSPECT = re.compile(r"([^\W\d_])\1\1|[^\W\d_][\W\d_]+[^\W\d_]|[0-9@$!|+(€£][^\W\d_]|[^\W\d_][0-9@$|+€£]")


LETTER = (1 << 21) - 1  # of packed letters, the last one


class Counts:
    """How often letters, packed into a number, occur: sorted arrays. Numbers that are in order are not sorted again."""

    def __init__(self, packed_: np.ndarray, times: np.ndarray):
        if (packed_[1:] < packed_[:-1]).any():
            order = np.argsort(packed_, kind="stable")
            packed_, times = packed_[order], times[order]
        first = np.flatnonzero(np.append(True, packed_[1:] != packed_[:-1])[: len(packed_)])
        self.keys = packed_ if len(first) == len(packed_) else packed_[first]
        self.times = times if len(first) == len(packed_) else np.add.reduceat(times, first)

    def of(self, key: int) -> float:
        at = int(np.searchsorted(self.keys, key))
        return float(self.times[at]) if at < len(self.keys) and self.keys[at] == key else 0.0


class Characters:
    """Log probabilities of a letter or EDGE after two others, backing off to one and to none."""

    def __init__(self, triples: np.ndarray, times: np.ndarray, doubled: Counts | None = None):
        self.doubled = doubled
        self.three = Counts(triples, times)
        triples, times = self.three.keys, self.three.times
        self.two, self.after_two = Counts(triples & ((LETTER << 21) | LETTER), times), Counts(triples >> 21, times)
        self.one = Counts(self.two.keys & LETTER, self.two.times)
        self.after_one = Counts(self.after_two.keys & LETTER, self.after_two.times)
        self.total = float(times.sum())
        self.kept: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        found = self.kept.get(key)
        if found is None:
            x, y, z = ord(a), ord(b), ord(c)
            p = (self.one.of(z) + 0.5) / (self.total + 500.0)
            p = (self.two.of((y << 21) | z) + 5.0 * p) / (self.after_one.of(y) + 5.0)
            p = (self.three.of((x << 42) | (y << 21) | z) + 5.0 * p) / (self.after_two.of((x << 21) | y) + 5.0)
            if len(self.kept) >= REMEMBERED:
                self.kept.clear()
            found = self.kept[key] = -math.log(p)
        return found

    def options(self, text: str, i: int) -> list[tuple[str, float]]:
        """What the sign at `i` may stand for ("" for nothing), at what cost."""
        sign = text[i]
        if sign.isalpha():
            return [(sign, 0.0), ("", REPEATED)] if i and text[i - 1] == sign else [(sign, 0.0)]
        return [(EDGE, 0.0), ("", NOISE), *((letter, STAND_IN) for letter in SIGNS.get(sign, ""))]

    def restored(self, text: str) -> str:
        """The cheapest path through the lattice of `text`: letters, with EDGE between words. However long the text is, only what
        open paths do not share is kept of them."""
        kept = self.kept
        paths: dict[tuple[str, str], tuple[float, tuple | None]] = {EDGES: (0.0, None)}
        before: list[str] = []
        for i in range(len(text)):
            if i and i % SETTLED == 0:
                shared, paths = settled(paths)
                before += shared
            found: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            options = self.options(text, i)
            for here, (cost, path) in paths.items():
                a, b = here
                for letter, extra in options:
                    if letter == "" or (letter == EDGE and b == EDGE):
                        best = found.get(here)
                        if best is None or cost + extra < best[0]:
                            found[here] = (cost + extra, path)
                        continue
                    step = kept.get(a + b + letter)
                    total = cost + extra + (self.cost(a, b, letter) if step is None else step)
                    state = EDGES if letter == EDGE else (b, letter)
                    best = found.get(state)
                    if best is None or total < best[0]:
                        found[state] = (total, (path, letter))
            paths = found
        ends = ((cost + (self.cost(a, b, EDGE) if b != EDGE else 0.0), path) for (a, b), (cost, path) in paths.items())
        path, letters = min(ends, key=lambda end: end[0])[1], []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join([*before, *reversed(letters)])

    def plain(self, word: str) -> str:
        """A word of letters, without the doubled ones that the corpus mostly has once."""
        if self.doubled is None or not DOUBLED.search(word) or not self.doubled.of(mark(word)):
            return word
        return self.single_letters(word)

    def single_letters(self, word: str) -> str:
        return self.restored(word)

    def words(self, token: str) -> list[str]:
        """The words a token stands for."""
        token = token.lower()
        core = token.rstrip(MARKS)
        if core.isalpha() and not DOUBLED.search(core):  # most tokens: nothing to restore
            return [core]
        if not SUSPECT.search(token):
            return [self.plain(w) for w in LETTERS.findall(token)]
        plain = [self.plain(w) for w in LETTERS.findall(token) if not SUSPECT.search(w)]
        return plain + [w for w in self.restored(token).split(EDGE) if w]


def settled(paths: dict) -> tuple[list[str], dict]:
    """The letters with which all open paths begin, and the paths without them."""
    chains = []
    for _, way in paths.values():
        chain = []
        while way is not None:
            chain.append(way)
            way = way[0]
        chains.append(chain[::-1])
    n = 0
    while all(len(chain) > n and chain[n] is chains[0][n] for chain in chains):
        n += 1
    rest = {}
    for (state, (cost, _)), chain in zip(paths.items(), chains):
        way = None
        for _, letter in chain[n:]:
            way = (way, letter)
        rest[state] = (cost, way)
    return [letter for _, letter in chains[0][:n]], rest


def mark(word: str) -> int:
    """A 64-bit number for a word."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}^" for n in BEGINNINGS if len(word) >= n)]


def single(piece: str) -> int:
    """The code point of a piece's only letter or sign that stands for one; 0 if it has another number of them."""
    inner = [ch for ch in piece if ch.isalpha() or ch in SIGNS]
    if len(inner) > 1:  # signs that may also set a letter apart
        inner = [ch for ch in inner if ch not in "!|+("]
    return ord(inner[0]) if len(inner) == 1 and len(piece) <= 3 else 0


def singles(token: str) -> list[int]:
    """`single` of each piece of a token between marks, where "!" inside may be a letter, too; [0] without pieces."""
    token = token.lower()
    core = token.rstrip(MARKS)
    if len(core) > 1 and core.isalpha():  # one piece of several letters
        return [0]
    return [single(piece) for piece in PIECES.findall(core or token)] or [0]


class Tokens(WordTable):
    """Per distinct token of a task, cut at white space, a value for each feature of the words it stands for, and `singles`."""

    at_marks = False

    def __init__(self, characters: Characters, value):
        self.characters, self.value = characters, value
        super().__init__()

    def forget(self) -> None:
        self.values, self.singles = Ragged(np.float64), Ragged(np.int32)

    def of(self, token: str) -> list[float]:
        return [v for w in self.characters.words(token) for f in features(w) if (v := self.value(f)) is not None]

    def fresh(self, tokens: list[str]) -> None:
        found = [self.of(token) for token in tokens]
        self.values.add(np.array([v for own in found for v in own], np.float64), np.array([len(own) for own in found]))
        apart = [singles(token) for token in tokens]
        self.singles.add(np.array([ch for own in apart for ch in own], np.int32), np.array([len(own) for own in apart]))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values of all texts, and the text each belongs to."""
        places, counts = self.places(texts)
        values, before = self.values.gathered(places)
        text = np.repeat(np.arange(len(texts)), np.diff(before[counts]))
        chars, before = self.singles.gathered(places)
        of = np.repeat(np.arange(len(texts)), np.diff(before[counts]))
        run = np.flatnonzero(chars > 0)
        if not len(run):
            return values, text
        cuts = np.flatnonzero((np.diff(run) != 1) | (of[run[1:]] != of[run[:-1]])) + 1
        more, owner = [], []
        for part in np.split(run, cuts):
            if len(part) < RUN:
                continue
            words = self.characters.restored(" ".join(map(chr, chars[part].tolist()))).split(EDGE)
            found = [v for w in words if len(w) > 1 for f in features(w) if (v := self.value(f)) is not None]
            more += found
            owner += [int(of[part[0]])] * len(found)
        return np.concatenate([values, more]), np.concatenate([text, np.array(owner, np.int64)])


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples of code points of words between EDGEs, packed into a number each, and how many each word has."""
    line = "".join(f"{EDGE}{EDGE}{word}{EDGE}" for word in words)
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(word) + 3 for word in words], np.int64)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return three[inside[:-2]], sizes - 2


def trigrams(known: DataFrame) -> DataFrame:
    """(letters, times): how often three letters or EDGEs, packed, follow each other in the tokens of letters of a vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.empty(0, np.int64), np.empty(0, np.float64)
        for batch in batches:
            found, sizes = triples(batch.column(0).to_pylist())
            keys = np.concatenate([keys, found])
            times = np.concatenate([times, np.repeat(batch.column(1).to_numpy(), sizes)])
            keys, where = np.unique(keys, return_inverse=True)
            times = np.bincount(where, times)
        yield pa.RecordBatch.from_pydict({"letters": pa.array(keys), "times": pa.array(times, pa.float64())})

    alone = known.where("alone > 0").select("word", "alone")
    return alone.mapInArrow(releasing(task), "letters long, times double").groupBy("letters").agg(F.sum("times").alias("times"))


def sent(numbers: DataFrame, chunk: int) -> list[Broadcast]:
    """The (long, double) rows as packed arrays in broadcasts of about `chunk` rows; the driver holds one at a time."""

    def packed(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(column).tobytes() for column in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array([column], pa.binary()) for column in columns], ["keys", "times"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for batch in batches:
            found.append([batch.column(i).to_numpy() for i in (0, 1)])
            rows += batch.num_rows
            if rows >= chunk:  # a file may hold many chunks
                yield packed(found)
                found, rows = [], 0
        if found:
            yield packed(found)

    stored = written(numbers, "numbers")
    parts = stored.coalesce(max(1, math.ceil(stored.count() / chunk))).mapInArrow(releasing(task), "keys binary, times binary")
    context = numbers.sparkSession.sparkContext
    return [context.broadcast((bytes(row["keys"]), bytes(row["times"]))) for row in parts.toLocalIterator()]


def received(chunks: list[Broadcast]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = (b"".join(chunk.value[i] for chunk in chunks) for i in (0, 1))
    return np.frombuffer(keys, np.int64), np.frombuffer(times, np.float64)


class Vocabulary(WordTable):
    """The distinct tokens of a task and how often they were met."""

    def __init__(self):
        self.full: list[dict[str, list[float]]] = []
        self.tokens: list[str] = []
        super().__init__(1 << 17)

    def forget(self) -> None:
        if self.tokens:
            self.full.append(self.words())
        self.tokens, self.times = [], np.zeros(0)

    def fresh(self, tokens: list[str]) -> None:
        self.tokens += tokens
        self.times = np.concatenate([self.times, np.zeros(len(tokens))])

    def words(self) -> dict[str, list[float]]:
        """How often each run of letters was met, and how often as a token of letters only."""
        found: dict[str, list[float]] = {}
        for token, times in zip(self.tokens, self.times.tolist()):
            lower = token.lower()
            if lower.isalpha() and token.isalpha():  # one run of letters
                known = found.setdefault(lower, [0.0, 0.0])
                known[0] += times
                known[1] += times
                continue
            for word in LETTERS.findall(lower):
                found.setdefault(word, [0.0, 0.0])[0] += times
            if token.isalpha():
                found.setdefault(lower, [0.0, 0.0])[1] += times
        return found


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, times, alone): how often each run of letters occurs, and how often as a token of letters only, over all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary()

        def counted(words: dict[str, list[float]]) -> pa.RecordBatch:
            times, alone = zip(*words.values()) if words else ((), ())
            columns = [pa.array(list(words), pa.string()), pa.array(times, pa.float64()), pa.array(alone, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "times", "alone"])

        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                places = table.places(part.column(0))[0]
                table.times += np.bincount(places, minlength=len(table.times))
                while table.full:
                    yield counted(table.full.pop())
        yield counted(table.words())

    counts = rows.select("text").mapInArrow(releasing(task), "word string, times double, alone double")
    return counts.groupBy("word").agg(F.sum("times").alias("times"), F.sum("alone").alias("alone"))


def doubled(known: DataFrame, model: Model) -> DataFrame:
    """(word, times): marks of words with a doubled letter that occur less often than what they are restored to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = model.characters()
        for batch in batches:
            found = []
            for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if DOUBLED.search(word) and not SUSPECT.search(word) and (other := characters.single_letters(word)) != word:
                    found.append((mark(word), times, other))
            columns = list(zip(*found)) or [(), (), ()]
            kinds = (pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mark", "times", "other"])

    known = known.where("times > 0").select("word", "times")
    found = known.mapInArrow(releasing(task), "mark long, times double, other string")
    more = known.select(F.col("word").alias("other"), F.col("times").alias("more"))
    return found.join(more, "other").where("more > times").select("mark", "times")


class Model:
    """The character model, and the words that lose doubled letters, as they are sent: in order, so that a task does not
    sort them. Both come from one vocabulary, which one pass over the texts counts."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK):
        known = written(vocabulary(rows), "vocabulary")
        self.doubled: list[Broadcast] = []
        self.chunks = sent(trigrams(known).orderBy("letters"), chunk)
        self.doubled = sent(doubled(known, self).orderBy("mark"), chunk)

    def characters(self) -> Characters:
        return Characters(*received(self.chunks), Counts(*received(self.doubled)))


def evidence(rows: DataFrame, model: Model, deviations: float = DEVIATIONS) -> dict[str, int]:
    """Features that tell toxic texts and a number for each, from (text, toxic) rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        tokens = Tokens(model.characters(), lambda feature: known.setdefault(feature, len(known)))
        with_it, toxic = np.zeros(0), np.zeros(0)
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                values, text = tokens.texts(part.column(0))
                flags = part.column(1).to_numpy()
                pairs = np.unique(text * (len(known) + 1) + values.astype(np.int64))
                text, place = pairs // (len(known) + 1), pairs % (len(known) + 1)
                grown = np.zeros(len(known) - len(with_it))
                with_it = np.concatenate([with_it, grown]) + np.bincount(place, minlength=len(known))
                toxic = np.concatenate([toxic, grown]) + np.bincount(place, flags[text], minlength=len(known))
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(list(known), pa.string()), "with_it": pa.array(with_it), "toxic": pa.array(toxic)}
        )

    counts = rows.select("text", "toxic").mapInArrow(releasing(task), "feature string, with_it double, toxic double")
    sums = counts.groupBy("feature").agg(F.sum("with_it").alias("n"), F.sum("toxic").alias("k"))
    # The lower end of Wilson's interval.
    z = deviations
    share, spread = F.col("k") / F.col("n"), F.lit(z * z) / F.col("n")
    low = (share + spread / 2 - z * F.sqrt((share * (1 - share) + spread / 4) / F.col("n"))) / (1 + spread)
    found = sums.withColumn("sure", low).where(F.col("sure") >= LEAST)
    passed = found.select("feature").orderBy("feature").toPandas()  # of at most SAMPLE rows
    return {feature: i for i, feature in enumerate(passed["feature"])}


def evidence_of(tokens: Tokens, texts: pa.Array, features_: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the known features of all texts, each once a text."""
    values, text = tokens.texts(texts)
    pairs = np.unique(text * (features_ + 1) + values.astype(np.int64))
    return pairs // (features_ + 1), pairs % (features_ + 1)


def weighed(rows: DataFrame, model: Model, known: dict[str, int]) -> np.ndarray:
    """A weight per feature, and that of no evidence last, fitted to the (text, toxic) rows of the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        tokens = Tokens(model.characters(), found.get)
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                text, feature = evidence_of(tokens, part.column(0), len(found))
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), lists], ["toxic", "features"])

    # At most SAMPLE rows; most have few features, or none.
    fitted = rows.select("text", "toxic").mapInArrow(releasing(task), "toxic double, features array<int>")
    counts = fitted.groupBy("features").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toPandas()
    order = counts["features"].map(list).map(tuple).sort_values().index
    counts = counts.loc[order]
    sizes = counts["features"].map(len).to_numpy(np.int64)
    feature = np.concatenate([*counts["features"], []]).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), sizes)
    k, n = counts["toxic"].to_numpy(np.float64), counts["n"].to_numpy(np.float64)
    weights, moved, squares = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    weights[-1] = -3.0
    for step in range(1, STEPS + 1):  # Adam
        odds = weights[-1] + np.bincount(text, weights[feature], minlength=len(counts))
        error = n / (1 + np.exp(-odds)) - k
        gradient = np.append(np.bincount(feature, error[text], minlength=len(known)), error.sum())
        gradient[:-1] += RIDGE * weights[:-1]
        moved = 0.9 * moved + 0.1 * gradient
        squares = 0.99 * squares + 0.01 * gradient**2
        weights -= 0.1 * (moved / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.99**step)) + 1e-9)
    return weights


def sampled(rows: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(most)
    joined = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most `most` rows
    return joined.select("text", F.least("toxic", F.lit(1.0)).alias("toxic"))


class Scorer:
    """What is fitted beside the character model: known features and their weights."""

    def __init__(self, learned: DataFrame, model: Model):
        self.known = evidence(learned, model)
        self.weights = weighed(learned, model, self.known)

    def scores(self, tokens: Tokens, texts: pa.Array) -> np.ndarray:
        text, feature = evidence_of(tokens, texts, len(self.known))
        odds = self.weights[-1] + np.bincount(text, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-odds))


def fitted(rows: DataFrame, labels: DataFrame) -> tuple[Model, Broadcast]:
    model = Model(rows)
    return model, rows.sparkSession.sparkContext.broadcast(Scorer(sampled(rows, labels), model))


def texts_of(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))


def scored(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", apart: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `df`."""
    rows = texts_of(df, text, doc_id)
    model, shared = fitted(rows, labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        tokens = Tokens(model.characters(), scorer.known.get)
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                score = scorer.scores(tokens, part.column(2))
                columns = [part.column(0), part.column(1), pa.array(score), pa.array((score >= LEAST).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    marked = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (held_out(doc_id) if apart is None else apart).alias("held_out"),
        text_of(text).alias("text"),
    )
    return marked.mapInArrow(releasing(task), "doc_id long, held_out boolean, score double, predicted int")


def accepted(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `df` with a score below LEAST, all columns. Only the numbers of the others leave the tasks that score."""
    model, shared = fitted(texts_of(df, text, doc_id), labels)
    rows = numbered(df)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        tokens = Tokens(model.characters(), scorer.known.get)
        for batch in batches:
            for part in slices(batch, "text", LIGHT_SLICE_BYTES):
                yield part.filter(pa.array(scorer.scores(tokens, part.column(1)) >= LEAST)).select([0])

    scored_ = rows.select("row", text_of(f"carried.`{text}`").alias("text"))
    return without(rows, written(scored_.mapInArrow(releasing(task), "row long"), "toxic")).select("carried.*")
