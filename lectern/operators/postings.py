"""Stored postings of a corpus of books, and the best books of a table of questions by BM25 with blocks left unread.

Every task cuts its books, as they lie, into blocks and inverts each block: a row holds a term, a block, and the ids, term
counts and lengths of the books of the block that hold the term, with the largest count and the least length, and how many
books and occurrences that are. Largest count and least length bound what the term can give to any book of the block, whatever the average length becomes. Texts are split into words once
and never moved; the row of the empty term lists all books of a block.

The best `n` books of each question come in two rounds. The bounds, a narrow read of the same table, give each
(question, block) the most that any of its books can score. The block of the largest bound is scored first; its n-th score is
the mark that the bound of any other block has to reach, or the block is not read for this question.

Books that come or go change the blocks they are in only: `updated` adds blocks for new books, takes books that left out of the
lists of their blocks, and changes the statistics by signed sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import doc_text, tokens
from lectern.operators.arrow import first_per_group
from lectern.operators.skew import SMALL_ROWS, fits
from lectern.sources.storage import written

# Constants of the published Okapi BM25 formula, with a floor for negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25

BLOCK_BOOKS = 512           # books of a block
BLOCK_WORDS = 1 << 20       # words of a block, a single longer book aside
QUESTIONS_PER_TASK = 2_048  # questions that meet a block in one task
SCORES_PER_STEP = 4_000_000
MARGIN = 1e-9               # scores are ranked to this precision
ALL = 1 << 62               # more books than a block holds

LISTS = ["ids", "tfs", "lengths"]
NUMBERS = ["max_tf", "min_length", "books", "words"]

Words = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Index:
    """`postings` (block, term, ids, tfs, lengths, max_tf, min_length, books, words) and `stats` (term, df, length).

    `generation` counts updates, so that block numbers are never given twice.
    """

    postings: DataFrame
    stats: DataFrame
    generation: int = 0

    def books(self) -> DataFrame:
        """(id, block, length) of every book."""
        whole = self.postings.where(F.col("term") == "")
        return whole.select("block", F.explode(F.arrays_zip("ids", "lengths")).alias("book")).select(
            F.col("book.ids").alias("id"), "block", F.col("book.lengths").alias("length")
        )


def words_of(books: DataFrame) -> DataFrame:
    """(id, words) of each book."""
    return books.select("id", tokens(doc_text(F.col("title"), F.col("summary"))).alias("words"))


def _inverted(ids: pa.Array, words: pa.Array, sizes: np.ndarray, block: int) -> pa.RecordBatch:
    """The rows of one block: its books first, then its terms in order."""
    n = len(ids)
    encoded = words.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    book = np.repeat(np.arange(n), sizes)
    pairs, counts = np.unique(rank[encoded.indices.to_numpy()] * n + book, return_counts=True)
    term, book = pairs // n, pairs % n
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
    length = sizes[book]
    offsets = pa.array(np.concatenate([[0], n + np.append(first, len(term))]).astype(np.int32))
    taken = pa.concat_arrays([ids, ids.take(pa.array(book))])
    most = np.append(0, np.maximum.reduceat(counts, first)) if len(first) else np.zeros(1)
    least = np.append(sizes.min(), np.minimum.reduceat(length, first)) if len(first) else sizes.min()[None]
    lists = [taken, pa.array(np.append(np.zeros(n), counts), pa.int32()), pa.array(np.append(sizes, length), pa.int32())]
    terms = pa.concat_arrays([pa.array([""]), encoded.dictionary.take(pa.array(order)).cast(pa.string())])
    columns = [pa.array(np.full(len(terms), block)), terms, *(pa.ListArray.from_arrays(offsets, x) for x in lists)]
    books = np.append(n, np.diff(np.append(first, len(term))))
    occurrences = np.append(sizes.sum(), np.add.reduceat(counts, first) if len(first) else [])
    columns += [pa.array(x, pa.int32()) for x in (most, least, books)] + [pa.array(occurrences, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", *LISTS, *NUMBERS])


def postings(
    books: DataFrame, generation: int = 0, block_books: int = BLOCK_BOOKS, block_words: int = BLOCK_WORDS, words: Words = words_of
) -> DataFrame:
    """The inverted blocks of `books`, each book in the block of the task that reads it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (generation << 48) | (TaskContext.get().partitionId() << 24)
        held: list[pa.RecordBatch] = []
        books_held = words_held = 0

        def emptied() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            flat = pa.concat_arrays([b.column(1).flatten() for b in held])
            sizes = np.concatenate([pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False) for b in held])
            return _inverted(ids, flat, sizes.astype(np.int64), block)

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, size in enumerate(sizes.tolist()):
                books_held, words_held = books_held + 1, words_held + size
                if books_held == block_books or words_held >= block_words:
                    held.append(batch.slice(start, i + 1 - start))
                    yield emptied()
                    held, start, books_held, words_held, block = [], i + 1, 0, 0, block + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield emptied()

    rows = words(books)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, term string, ids array<{kind}>, tfs array<int>, lengths array<int>"
    schema += ", max_tf int, min_length int, books int, words long"
    return rows.mapInArrow(task, schema)


def stats_of(rows: DataFrame) -> DataFrame:
    """(term, df, length) of postings; the row of the empty term has the numbers of books and of words."""
    words = F.when(F.col("term") == "", F.col("words")).otherwise(0)
    return rows.groupBy("term").agg(F.sum("books").alias("df"), F.sum(words).alias("length"))


def indexed(books: DataFrame, **settings) -> Index:
    """The index of `books`; `settings` are those of `postings`. Both tables are written to the shared folder."""
    rows = written(postings(books, **settings), "postings")
    return Index(rows, written(stats_of(rows), "corpus"))


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, term, ids, tfs, lengths, gone) of postings without the books named in `gone`, a list that all rows of a block
    share; a term that no book is left of goes, the row of the empty term stays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, term, gone = (batch.column(c) for c in ("block", "term", "gone"))
        ids, tfs, lengths = (batch.column(c).flatten() for c in LISTS)
        size = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        number = block.to_numpy(zero_copy_only=False)
        keep = pc.is_valid(ids).to_numpy(zero_copy_only=False).copy()
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist()
        for a, z in zip(first, [*first[1:], len(number)]):
            low, high = end[a] - size[a], end[z - 1]
            keep[low:high] &= ~pc.is_in(ids.slice(low, high - low), value_set=gone[a].values).to_numpy(zero_copy_only=False)
        before = np.append(0, np.cumsum(keep))
        left = before[end] - before[end - size]
        offsets = np.append(0, np.cumsum(left))
        ids, tf, length = ids.filter(pa.array(keep)), tfs.to_numpy()[keep], lengths.to_numpy()[keep]
        whole, some = pc.equal(term, "").to_numpy(zero_copy_only=False), left > 0
        most, least = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        if some.any():
            most[some], least[some] = np.maximum.reduceat(tf, offsets[:-1][some]), np.minimum.reduceat(length, offsets[:-1][some])
        sums = np.append(0, np.cumsum(np.where(np.repeat(whole, left), length, tf), dtype=np.int64))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (ids, pa.array(tf, pa.int32()), pa.array(length, pa.int32()))]
        numbers = [pa.array(x, pa.int32()) for x in (most, least, left)] + [pa.array(sums[offsets[1:]] - sums[offsets[:-1]])]
        out = pa.RecordBatch.from_arrays([block, term, *lists, *numbers], ["block", "term", *LISTS, *NUMBERS])
        yield out.filter(pa.array(some | whole))


def updated(index: Index, added: DataFrame, removed: DataFrame, **settings) -> Index:
    """The index after the books of `added` came and those named in `removed` (id) left.

    Only blocks that hold a book that left are written anew, and new books get blocks of their own; the
    statistics take signed sums of what these blocks counted before and after.
    """
    generation = index.generation + 1
    fresh = postings(added, generation, **settings)
    going = removed.select("id").distinct()
    located = index.books().select("id", "block")
    touched = located.join(F.broadcast(going) if fits(going) else going, "id").groupBy("block").agg(F.collect_set("id").alias("gone"))
    touched = written(touched, "touched-blocks")
    few = F.broadcast(touched) if fits(touched) else touched
    before = index.postings.join(few, "block")
    after = before.select("block", "term", *LISTS, "gone").mapInArrow(_left_over, fresh.schema)
    changed = written(after.unionByName(fresh), "postings")
    signed = [index.stats, stats_of(changed), stats_of(before.drop("gone")).select("term", (-F.col("df")).alias("df"), (-F.col("length")).alias("length"))]
    sums = signed[0].unionByName(signed[1]).unionByName(signed[2])
    stats = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where("df > 0 or term = ''")
    kept = index.postings.join(few.select("block"), "block", "left_anti")
    return Index(kept.unionByName(changed), written(stats, "corpus"), generation)


# --- scores -----------------------------------------------------------------------------------------------


def corpus_totals(stats: DataFrame) -> DataFrame:
    """(n_docs, avg_length) of the corpus."""
    return stats.where(F.col("term") == "").select(
        F.col("df").alias("n_docs"), F.try_divide(F.col("length"), F.col("df")).alias("avg_length")
    )


def term_weights(stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(term, df, idf); a negative weight becomes `epsilon` times the mean weight."""
    docs = corpus_totals(stats).select("n_docs").scalar()
    raw = F.log(docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = stats.where(F.col("term") != "").select("term", "df", raw.alias("idf"))
    floor = weighed.agg(F.avg("idf") * epsilon).scalar()
    return weighed.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): the words of each query; a repeated word counts as often as it stands there."""
    words = queries.select("query_id", F.explode_outer(tokens(F.col("query"))).alias("term"))
    return words.where(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def saturated(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """What a term gives to a book before its weight: grows with its count, falls with the length of the book."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted to be small."""
    return F.broadcast(df) if fits(df) else df


def asked_weights(queries: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, term, weight) of the words of questions that the corpus knows."""
    asked = query_terms(queries)
    weights = term_weights(stats, epsilon).select("term", "idf")
    return weights.join(_small(asked), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))


def bm25_top(
    queries: DataFrame,
    index: Index,
    n: int = 10,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    per_task: int = QUESTIONS_PER_TASK,
) -> DataFrame:
    """(query_id, id, bm25_score, rank): the best `n` books of each question that share a word with it.

    Equal scores, to nine digits, go by id. Output is bounded by n rows a question.
    """
    pairs, score = _prepared(queries, index, n, k1, b, epsilon, per_task)
    best = F.max(F.struct("bound", "block")).alias("best")
    first = pairs.groupBy("query_id").agg(best).select("query_id", "best.block")
    opened = written(score(first), "opened-blocks")
    mark = _ranked(opened, n).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("bm25_score").alias("mark"))
    rest = pairs.join(first.select("query_id", F.col("block").alias("opened")), "query_id").where("block <> opened")
    rest = rest.join(mark, "query_id", "left").where(
        F.col("found").isNull() | (F.col("found") < n) | (F.col("bound") >= F.col("mark") - 2 * MARGIN)
    )
    return _ranked(opened.unionByName(score(rest.select("query_id", "block"))), n)


def bm25_all(
    queries: DataFrame,
    index: Index,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    per_task: int = QUESTIONS_PER_TASK,
) -> DataFrame:
    """(query_id, id, bm25_score): every book that shares a word with a question, each block scored by itself.

    Rows of an id that several blocks hold are added up.
    """
    pairs, score = _prepared(queries, index, ALL, k1, b, epsilon, per_task)
    scored = score(pairs.select("query_id", "block"))
    if index.books().groupBy("id").count().where("count > 1").isEmpty():
        return scored
    return scored.groupBy("query_id", "id").agg(F.sum("bm25_score").alias("bm25_score"))


def _ranked(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25_score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _prepared(
    queries: DataFrame, index: Index, n: int, k1: float, b: float, epsilon: float, per_task: int
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(query_id, block, bound) for all blocks that hold a word of a question, and the function that scores such pairs."""
    weighted = written(asked_weights(queries, index.stats, epsilon), "asked-weights")
    entry = F.collect_list(F.struct("term", "weight")).alias("words")
    lists = weighted.groupBy("query_id").agg(entry)
    lists = lists.select("query_id", F.col("words.term").alias("terms"), F.col("words.weight").alias("weights"))
    number = weighted.count()
    small = F.broadcast if number <= SMALL_ROWS else (lambda df: df)
    groups = -(-queries.count() // per_task) if number else 1
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(groups, 1))).alias("part")
    average = (corpus_totals(index.stats).first() or [None, None])[1] or 1.0
    terms = weighted.select("term").distinct()
    hits = index.postings.join(small(terms), "term")

    most = saturated(F.col("max_tf"), F.col("min_length"), F.lit(average), k1, b)
    bounds = index.postings.select("block", "term", most.alias("most")).join(small(weighted), "term")
    pairs = written(
        bounds.groupBy("query_id", "block").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("most")).alias("bound")), "bounds"
    )
    kind = index.postings.schema["ids"].dataType.elementType.simpleString()

    def block(held: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": asking["query_id"].slice(0, 0), "id": held["ids"].slice(0, 0).combine_chunks().flatten(), "bm25_score": pa.array([], pa.float64())})
        if not held.num_rows or not asking.num_rows:
            return empty
        held = held.combine_chunks()
        ids, tfs, lengths = (held[c].combine_chunks().flatten() for c in ("ids", "tfs", "lengths"))
        tf, length = tfs.to_numpy().astype(float), lengths.to_numpy().astype(float)
        value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        size = pc.list_value_length(held["ids"]).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        names, book = np.unique(ids.to_numpy(), return_inverse=True)
        asked = asking["terms"].combine_chunks()
        weights = asking["weights"].combine_chunks().flatten().to_numpy()
        question = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
        at = pc.fill_null(pc.index_in(asked.flatten(), value_set=held["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        there = at >= 0
        at, weights, question = at[there], weights[there], question[there]
        found = []
        step = max(SCORES_PER_STEP // len(names), 1)
        for low in range(0, len(asked), step):
            some = (question >= low) & (question < low + step)
            own, each = at[some], size[at[some]]
            before = np.cumsum(each) - each
            place = np.repeat(start[own] - before, each) + np.arange(each.sum())
            cell = np.repeat(question[some] - low, each) * len(names) + book[place]
            cells = min(step, len(asked) - low) * len(names)
            score = np.bincount(cell, np.repeat(weights[some], each) * value[place], cells)
            touched = np.flatnonzero(np.bincount(cell, minlength=cells))
            asker, named, score = touched // len(names), touched % len(names), score[touched]
            best = first_per_group(asker, -np.round(score, 9), names[named], n)
            found.append((asker[best] + low, named[best], score[best]))
        asker, named, score = (np.concatenate(x) for x in zip(*found))
        return pa.table(
            {"query_id": asking["query_id"].take(pa.array(asker)), "id": pa.array(names[named]).cast(ids.type), "bm25_score": pa.array(score)}
        )

    def score(chosen: DataFrame) -> DataFrame:
        asking = chosen.join(small(lists), "query_id").select("query_id", "block", group, "terms", "weights")
        wanted = chosen.select("block", group).distinct()
        held = hits.select("block", "term", "ids", "tfs", "lengths").join(wanted, "block")
        both = held.groupBy("block", "part").cogroup(asking.groupBy("block", "part"))
        return both.applyInArrow(block, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, bm25_score double")

    return pairs, score


def pair_scores(
    candidates: DataFrame, queries: DataFrame, index: Index, k1: float = K1, b: float = B, epsilon: float = EPSILON
) -> DataFrame:
    """(query_id, id, bm25_score) of the candidates (query_id, id) that share a word with their question, from the postings."""
    average = corpus_totals(index.stats).select("avg_length").scalar()
    weighted = written(asked_weights(queries, index.stats, epsilon), "asked-weights")
    wanted = candidates.select("query_id", "id")
    located = index.books().select("id", "block").join(_small(wanted), "id")
    lookups = written(located.join(weighted, "query_id"), "lookups")
    place = F.array_position("ids", F.col("id"))
    found = index.postings.join(_small(lookups), ["term", "block"]).where(place > 0)
    tf, length = (F.element_at(c, place.cast("int")).cast("double") for c in ("tfs", "lengths"))
    score = F.sum(F.col("weight") * saturated(tf, length, average, k1, b))
    return found.groupBy("query_id", "id").agg(score.alias("bm25_score"))
