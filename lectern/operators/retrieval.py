"""Hybrid retrieval for tables of queries: dense candidates, BM25, re-ranking, prompt context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import media_url, no_summary
from lectern.functions.vectors import SUMMARY_WEIGHT, TITLE_WEIGHT, dot
from lectern.operators import postings
from lectern.operators.arrow import matrix
from lectern.operators.neighbours import BLOCK_ROWS, PIVOTS, Space, nearest, vectors
from lectern.operators.postings import B, EPSILON, K1, Index, corpus_totals, query_terms, saturated, term_weights
from lectern.operators.skew import SMALL_ROWS, join_checked
from lectern.sources.storage import written

CANDIDATE = (
    "query_id long, id int, title_similarity double, summary_similarity double, combined_similarity double"
)

REGULAR, ODD, ABSENT = range(3)  # both vectors have a length; one has none; one is NULL


# --- dense candidates -------------------------------------------------------------------------------------


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row without length becomes NaN, as its cosine does."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.where((lengths == 0) | ~np.isfinite(lengths), np.nan, rows / lengths)


def weighted_cosine() -> Space:
    """Books and questions as points whose squared distance is the weighted sum of the two cosine distances: for unit vectors
    1 - cos is half the squared distance."""
    title, summary = np.sqrt(TITLE_WEIGHT / 2), np.sqrt(SUMMARY_WEIGHT / 2)

    def books(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.hstack([title * _unit(vectors(rows, "title_embed")), summary * _unit(vectors(rows, "summary_embed"))])

    def questions(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        unit = _unit(vectors(rows, "query_embed"))
        return np.hstack([title * unit, summary * unit])

    def measured(points: pa.Table, asked: pa.Table):
        unit = _unit(vectors(asked, "query_embed"))
        parts = [1.0 - unit @ _unit(vectors(points, name)).T for name in ("title_embed", "summary_embed")]
        key = np.round(TITLE_WEIGHT * parts[0] + SUMMARY_WEIGHT * parts[1], 12)
        return key, lambda question, point: [part[question, point] for part in parts]

    return Space(
        books, questions, measured, lambda key: F.sqrt(F.greatest(key, F.lit(0.0))), ("title_similarity", "summary_similarity")
    )


def _has_length(c: str) -> Column:
    squared = dot(F.col(c), F.col(c))
    return (squared > 0) & (squared < float("inf"))


def _without_number(asked: DataFrame, books: DataFrame, kinds: Column, k: int) -> DataFrame:
    """For each question the first `k` books by id whose distance is NaN (of the given kinds), and the first `k` whose
    distance is NULL; at most 2k books, handed to the tasks."""
    firsts = [books.where(kind).orderBy("id").limit(k) for kind in (kinds, F.col("kind") == ABSENT)]
    rows = reduce(DataFrame.unionByName, firsts).select("id", "title_embed", "summary_embed").toArrow().combine_chunks()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(vectors(batch, "query_embed"))
            columns = [batch.column("query_id").take(pa.array(np.repeat(np.arange(len(unit)), rows.num_rows)))]
            columns.append(pa.concat_arrays([rows["id"].combine_chunks()] * len(unit)))
            masks = []
            for name in ("title_embed", "summary_embed"):
                embed, missing = matrix(rows[name].combine_chunks(), unit.shape[1])
                masks.append(np.tile(missing, len(unit)))
                columns.append(pa.array((1.0 - unit @ _unit(embed).T).ravel(), pa.float64(), mask=masks[-1]))
            columns.append(pa.array(np.full(len(masks[0]), np.nan), pa.float64(), mask=masks[0] | masks[1]))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CANDIDATE.split(", ")])

    if not rows.num_rows:
        return asked.sparkSession.createDataFrame([], CANDIDATE)
    return asked.select("query_id", "query_embed").mapInArrow(task, CANDIDATE)


def dense_top(queries: DataFrame, books: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The `k` books of least weighted cosine distance for each (query_id, query_embed).

    Books and questions meet as blocks; a block goes only to groups of questions that its distance to a pivot does not
    rule out (see `neighbours`). Distances that are NULL rank last, NaN just before, where there are fewer than `k` numbers;
    equal distances go by id.
    """
    kind = (
        F.when(F.col("title_embed").isNull() | F.col("summary_embed").isNull(), ABSENT)
        .when(_has_length("title_embed") & _has_length("summary_embed"), REGULAR)
        .otherwise(ODD)
    )
    staged = written(
        books.select(F.col("id").cast("int").alias("id"), "title_embed", "summary_embed", kind.alias("kind")), "book-vectors"
    )
    asked = queries.where(F.col("query_embed").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "query_embed")
    asked = written(asked.withColumn("regular", _has_length("query_embed")), "question-vectors")
    points = staged.where(F.col("kind") == REGULAR).drop("kind")
    regular = asked.where("regular").drop("regular")
    found = nearest(points, regular, weighted_cosine(), k, block_rows, pivots).select(
        "query_id", "id", "title_similarity", "summary_similarity", F.col("key").alias("combined_similarity")
    )
    if points.count() < k:
        found = found.unionByName(_without_number(regular, staged, F.col("kind") == ODD, k))
    odd = asked.where("not regular")
    if not odd.isEmpty():
        found = found.unionByName(_without_number(odd, staged, F.col("kind") < ABSENT, k))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("combined_similarity"), "id")
    return found.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k)


# --- BM25 -------------------------------------------------------------------------------------------------


def documents(books: DataFrame) -> DataFrame:
    """(id, words) of each book. Read the words out with explode_outer: the filter on the array's size
    that an inner explode adds would split the text a second time."""
    return postings.words_of(books)


def corpus_stats(books: DataFrame) -> DataFrame:
    """(term, df, length): documents holding each term, in one pass over the texts.

    The row of the empty term stands for the corpus: df is the number of documents and length the number of words.
    """
    terms = documents(books).select(
        F.size("words").alias("length"),
        F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("term"),
    )
    return terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term") == "", F.col("length")).otherwise(0)).alias("length"),
    )


def bm25(
    queries: DataFrame,
    books: DataFrame,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    stats: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, bm25_score) of every book that shares a word with the query; any other score is 0. For the best
    books only, see `postings.bm25_top`.

    Words no query asks for are dropped where they are read, so only asked words are counted and moved. The words of the
    queries are broadcast, in as many passes over the counted words as their number needs.
    """
    stats = written(corpus_stats(books), "corpus") if stats is None else stats
    average = corpus_totals(stats).select("avg_length").scalar()
    asked = query_terms(queries)
    passes = max(1, -(-asked.count() // SMALL_ROWS))
    weights = term_weights(stats, epsilon).select("term", "idf").join(asked.select("term").distinct(), "term")
    words = documents(books).select("id", F.size("words").alias("length"), F.explode_outer("words").alias("term"))
    counted = (
        join_checked(words, weights, ["term"], sized_by=asked)
        .groupBy("id", "length", "term", "idf")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    scored = counted.select(
        "id", "term", (F.col("idf") * saturated(F.col("tf"), F.col("length"), average, k1, b)).alias("score")
    )
    if passes > 1:
        scored = written(scored, "scored")
    parts = [asked.where(F.pmod(F.xxhash64("query_id", "term"), F.lit(passes)) == n) for n in range(passes)]
    matched = reduce(DataFrame.unionByName, [scored.join(F.broadcast(part), "term") for part in parts])
    return matched.groupBy("query_id", "id").agg(F.sum(F.col("score") * F.col("times")).alias("bm25_score"))


def attach_bm25(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with their score, 0 where there is none."""
    return candidates.join(scores, ["query_id", "id"], "left").withColumn(
        "bm25_score", similarity_or_zero(F.col("bm25_score"))
    )


# --- fusion -----------------------------------------------------------------------------------------------


def rerank(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` candidates of each query by BM25; equal scores keep the dense order."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("bm25_score", 9)), F.asc_nulls_last("combined_similarity"), "id"
    )
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _label(c: Column, text: str) -> Column:
    """The text that stands for a distance that is missing."""
    return F.when(c.isNull() | F.isnan(c), F.lit(text))


def with_texts(candidates: DataFrame, books: DataFrame, small: bool) -> DataFrame:
    """Candidates with the other columns of their books; texts stay in place when the candidates are known to be
    `small`."""
    texts = books.drop("title_embed", "summary_embed").withColumn("id", F.col("id").cast("int"))
    return texts.join(F.broadcast(candidates) if small else candidates, "id")


def hybrid_search(queries: DataFrame, books: DataFrame, k: int = 10, n: int = 3, index: Index | None = None) -> DataFrame:
    """Ranked suggestions for each query: `k` dense candidates, the best `n` of them by BM25.

    `index` are stored postings of the same books; without it they are made for this call.
    """
    index = index or postings.indexed(books)
    small = queries.count() * k <= SMALL_ROWS
    candidates = written(with_texts(dense_top(queries, books, k), books, small), "candidates")
    ranked = rerank(attach_bm25(candidates, postings.pair_scores(candidates, queries, index)), n)
    return (
        ranked.withColumn("summary", no_summary(F.col("summary")))
        .withColumn("image", media_url(F.col("image")))
        .withColumn("summary_label", _label(F.col("summary_similarity"), "No summary available"))
        .withColumn("title_label", _label(F.col("title_similarity"), "No title available"))
        .withColumn("combined_label", _label(F.col("combined_similarity"), "No combined similarity available"))
    )


PROMPT = "User input: %s\nBook suggestions:\n%s"


def prompt_context(suggestions: DataFrame, queries: DataFrame, template: str = PROMPT) -> DataFrame:
    """(query_id, query, context, prompt): the suggestions of a query as JSON, in rank order, and the filled template."""
    entry = F.struct(
        "rank", "id", "title", no_summary(F.col("summary"), "No summary available.").alias("summary")
    )
    listed = suggestions.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_listed"))
    context = F.to_json(F.transform("_listed", lambda s: F.struct(s["id"], s["title"], s["summary"])))
    return (
        listed.select("query_id", context.alias("context"))
        .join(queries.select("query_id", "query"), "query_id")
        .withColumn("prompt", F.format_string(template, "query", "context"))
    )


def similarity_or_zero(c: Column) -> Column:
    """A distance for a prompt, 0 when it is missing."""
    return F.coalesce(c, F.lit(0.0))
