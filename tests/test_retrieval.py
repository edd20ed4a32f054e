import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import neighbours, postings, retrieval

BOOK = "id int, title string, summary string, image string, title_embed array<float>, summary_embed array<float>"


def make_books(n=120, dim=4, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the"] * 40

    def vector():
        kind = rng.random()
        if kind < 0.1:
            return None
        if kind < 0.2:
            return [0.0] * dim
        return [rng.choice([-1.0, -0.5, 0.5, 1.0, 2.0]) for _ in range(dim)]  # many equal distances

    return [
        (i, " ".join(rng.choices(words, k=3)), "NaN" if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 20))),
         "" if i % 4 == 0 else f"{i}.jpg", vector(), vector())
        for i in range(n)
    ]


BOOKS = make_books()
QUESTIONS = [(i, q, [1.0, 0.5, -1.0, float(i % 3)]) for i, q in enumerate(["w1 w2", "THE the w3", "absent words", "", "w1 w1"])]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, BOOK).repartition(5)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string, query_embed array<float>")


def expected_dense(query, k):
    def distance(vector):
        if vector is None:
            return None
        a, b = np.array(vector), np.array(query)
        if not a.any():
            return math.nan
        return 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    def key(row):
        title, summary = distance(row[4]), distance(row[5])
        if title is None or summary is None:
            return (2, 0.0, row[0])
        total = 0.5 * title + 0.75 * summary
        return (1, 0.0, row[0]) if math.isnan(total) else (0, round(total, 12), row[0])

    return [row[0] for row in sorted(BOOKS, key=key)[:k]]


@pytest.mark.parametrize(
    "k, block_rows, pivots, step", [(10, 2048, 99, 4_000_000), (10, 2, 99, 4_000_000), (3, 16, 2, 4_000_000), (115, 2048, 9, 40), (500, 7, 9, 40)]
)
def test_dense_top(books, questions, monkeypatch, k, block_rows, pivots, step):
    monkeypatch.setattr(neighbours, "CELLS_PER_STEP", step)
    found = retrieval.dense_top(questions, books, k, block_rows, pivots).orderBy("query_id", "dense_rank").collect()
    for query_id, _, vector in QUESTIONS:
        assert [r["id"] for r in found if r["query_id"] == query_id] == expected_dense(vector, k)
    for row in found:
        title, summary, total = row["title_similarity"], row["summary_similarity"], row["combined_similarity"]
        if title is None or summary is None:
            assert total is None
        elif not math.isnan(total):
            assert total == pytest.approx(0.5 * title + 0.75 * summary)


def test_queries_without_vector_find_nothing(spark, books):
    asked = spark.createDataFrame([(1, "x", None)], "query_id long, query string, query_embed array<float>")
    assert retrieval.dense_top(asked, books).count() == 0
    assert retrieval.dense_top(asked, books.where("false")).count() == 0


def test_queries_without_length_take_the_first_books_by_id(spark, books):
    asked = spark.createDataFrame([(1, [0.0] * 4), (2, [float("nan")] * 4)], "query_id long, query_embed array<float>")
    found = retrieval.dense_top(asked, books, 100).orderBy("query_id", "dense_rank").collect()
    whole = [row[0] for row in BOOKS if row[4] is not None and row[5] is not None]
    rest = [row[0] for row in BOOKS if row[4] is None or row[5] is None]
    for query_id in (1, 2):
        assert [r["id"] for r in found if r["query_id"] == query_id] == (whole + rest)[:100]
    for row in found:
        total = row["combined_similarity"]
        assert math.isnan(total) if row["id"] in whole else total is None


def okapi(query):
    """Scores of all books by the published formula."""
    docs = {row[0]: (row[1] + " " + row[2]).lower().split() for row in BOOKS}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(word for words in docs.values() for word in set(words))
    idf = {word: math.log(n - f + 0.5) - math.log(f + 0.5) for word, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {word: floor if value < 0 else value for word, value in idf.items()}
    scores = {}
    for book, words in docs.items():
        tf = Counter(words)
        scores[book] = sum(
            idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / average)) for w in query.lower().split()
        )
    return scores


@pytest.mark.parametrize("small_rows", [1_000_000, 3])
def test_bm25(books, questions, monkeypatch, small_rows):
    monkeypatch.setattr(retrieval, "SMALL_ROWS", small_rows)  # the query words in one pass, or in several
    found = {(r["query_id"], r["id"]): r["bm25_score"] for r in retrieval.bm25(questions, books).collect()}
    for query_id, query, _ in QUESTIONS:
        for book, score in okapi(query).items():
            assert found.get((query_id, book), 0.0) == pytest.approx(score, abs=1e-9)
    assert found[4, 1] == pytest.approx(2 * okapi("w1")[1]) if (4, 1) in found else True
    assert any(okapi("the").values()) and min(okapi("the").values()) >= 0  # the floor was needed


def test_candidate_scores_equal_all_scores(books, questions):
    candidates = retrieval.dense_top(questions, books)
    scores = postings.pair_scores(candidates, questions, postings.indexed(books, block_books=13))
    scored = retrieval.attach_bm25(candidates, scores).collect()
    assert len(scored) == 50
    for row in scored:
        query = next(q for i, q, _ in QUESTIONS if i == row["query_id"])
        assert row["bm25_score"] == pytest.approx(okapi(query)[row["id"]], abs=1e-9)
    attached = retrieval.attach_bm25(candidates, retrieval.bm25(questions, books))
    assert {(r["query_id"], r["id"]): round(r["bm25_score"], 9) for r in attached.collect()} == {
        (r["query_id"], r["id"]): round(r["bm25_score"], 9) for r in scored
    }


def test_rerank_order(spark):
    # A published example of candidates with combined distance and score.
    rows = [
        (1, 122, 0.6180413806169818, 4.885859841788541), (1, 37, 0.5219848025362775, 12.999399060226125),
        (1, 76, 0.4500101187782121, 13.919523133547825), (1, 103, 0.5205595500479425, 6.137649794785171),
        (1, 77, 0.4990571637584824, 10.018497804889478),
    ]
    candidates = spark.createDataFrame(rows, "query_id long, id int, combined_similarity double, bm25_score double")
    assert [r["id"] for r in retrieval.rerank(candidates).orderBy("rank").collect()] == [76, 37, 77, 103, 122]
    assert [r["id"] for r in retrieval.rerank(candidates, 3).orderBy("rank").collect()] == [76, 37, 77]
    level = candidates.withColumn("bm25_score", F.lit(0.0))
    assert [r["id"] for r in retrieval.rerank(level).orderBy("rank").collect()] == [76, 77, 103, 37, 122]


def test_hybrid_search(books, questions):
    found = retrieval.hybrid_search(questions, books, k=10, n=3).collect()
    stored = retrieval.hybrid_search(questions, books, k=10, n=3, index=postings.indexed(books, block_books=9)).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["summary"]) for r in stored) == sorted(
        (r["query_id"], r["rank"], r["id"], r["summary"]) for r in found
    )
    for query_id, query, vector in QUESTIONS:
        near = expected_dense(vector, 10)
        scores = okapi(query)
        ranked = sorted(near, key=lambda book: -round(scores[book], 9))[:3]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query_id] == ranked
    for row in found:
        book = BOOKS[row["id"]]
        assert row["summary"] == ("No summary available" if book[2] == "NaN" else book[2])
        assert row["image"] == (f"/media/calibre-library-image/{book[3]}" if book[3] else None)
        assert (row["title_label"] is None) == (row["title_similarity"] is not None and not math.isnan(row["title_similarity"]))


def test_prompt_context(spark, questions):
    rows = [(0, 2, 5, "B \"q\"", "NaN"), (0, 1, 9, "A", "text\nline")]
    suggestions = spark.createDataFrame(rows, "query_id long, rank int, id int, title string, summary string")
    found = retrieval.prompt_context(suggestions, questions, "%s|%s").first()
    assert json.loads(found["context"]) == [
        {"id": 9, "title": "A", "summary": "text\nline"},
        {"id": 5, "title": 'B "q"', "summary": "No summary available."},
    ]
    assert found["prompt"] == "w1 w2|" + found["context"]


def test_similarity_or_zero(spark):
    rows = spark.createDataFrame([(None,), (0.25,)], "d double")
    assert [r["v"] for r in rows.select(retrieval.similarity_or_zero(F.col("d")).alias("v")).collect()] == [0.0, 0.25]
