"""Stored postings against the published formula in plain Python, and blocks that are not read."""

import math
import random
from collections import Counter

import pytest

from lectern.operators import postings, retrieval

BOOK = "id int, title string, summary string"


def corpus(n=300, seed=4):
    """Books of two kinds: a third of all words is "the", rare words lie in few books, some books are empty."""
    rng = random.Random(seed)
    common, rare = ["the"] * 30 + [f"c{i}" for i in range(20)], [f"r{i}" for i in range(200)]
    rows = [(i, rng.choice(common), " ".join(rng.choices(common + rare[i // 2 : i // 2 + 3], k=rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", " \t"), (n + 2, "THE The", "the " * 500), (n + 3, "twin", "r7 r7"), (n + 4, "twin", "r7 r7")]


QUESTIONS = [(1, "the r7 c3"), (2, "r10 r11 R10"), (3, "the"), (4, ""), (5, None), (6, "unknown words"), (7, " ".join(f"c{i}" for i in range(20)) + " r150"), (8, "twin")]


def scores(books, query):
    docs = {i: f"{t or ''} {s or ''}".lower().split() for i, t, s in books}
    average = sum(map(len, docs.values())) / len(docs)
    df = Counter(word for words in docs.values() for word in set(words))
    idf = {w: math.log(len(docs) - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    asked = [w for w in (query or "").lower().split() if w in idf]
    out = {}
    for i, words in docs.items():
        tf = Counter(words)
        if any(tf[w] for w in asked):
            out[i] = sum(
                (idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / average)) for w in asked
            )
    return out


def check(found, books, n):
    got = {}
    for row in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(row["query_id"], []).append((row["id"], row["bm25_score"]))
    for query_id, query in QUESTIONS:
        all_ = scores(books, query)
        best = sorted(all_, key=lambda i: (-round(all_[i], 9), i))[:n]
        assert [i for i, _ in got.get(query_id, [])] == best, query
        assert all(score == pytest.approx(all_[i], abs=1e-9) for i, score in got.get(query_id, []))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


@pytest.mark.parametrize("block_books, block_words, n, per_task", [(512, 1 << 20, 10, 2048), (7, 1 << 20, 10, 2), (50, 100, 3, 2048), (1, 9, 400, 3)])
def test_best_books(spark, questions, block_books, block_words, n, per_task):
    books = corpus()
    df = spark.createDataFrame(books, BOOK).repartition(4)
    index = postings.indexed(df, block_books=block_books, block_words=block_words)
    check(postings.bm25_top(questions, index, n, per_task=per_task).collect(), books, n)


def test_blocks_hold_each_book_once_and_their_bounds(spark):
    books = corpus()
    rows = postings.indexed(spark.createDataFrame(books, BOOK).repartition(3), block_books=20).postings.collect()
    whole = [row for row in rows if row["term"] == ""]
    assert sorted(i for row in whole for i in row["ids"]) == [b[0] for b in books]
    assert max(len(row["ids"]) for row in whole) <= 20 and len({row["block"] for row in whole}) == len(whole)
    docs = {i: Counter(f"{t or ''} {s or ''}".lower().split()) for i, t, s in books}
    seen = Counter()
    for row in rows:
        if row["term"]:
            for i, tf, length in zip(row["ids"], row["tfs"], row["lengths"]):
                assert docs[i][row["term"]] == tf and sum(docs[i].values()) == length
                seen[i, row["term"]] += 1
            assert row["max_tf"] == max(row["tfs"]) and row["min_length"] == min(row["lengths"])
    assert seen == Counter((i, w) for i, words in docs.items() for w in words)


def test_blocks_below_the_mark_are_not_read(spark):
    rows = [(i, "x", "the " * 9 + (f"gold{'gold ' * 3}" if i < 5 else "gold " if i % 50 == 0 else "")) for i in range(400)]
    rows = [(i, t, s.replace("goldgold", "gold")) for i, t, s in rows]
    index = postings.indexed(spark.createDataFrame(rows, BOOK).coalesce(1), block_books=20)
    asked = spark.createDataFrame([(1, "gold")], "query_id long, query string")
    pairs, _ = postings._prepared(asked, index, 5, postings.K1, postings.B, postings.EPSILON, 100)
    bounds = {r["block"]: r["bound"] for r in pairs.collect()}
    best = postings.bm25_top(asked, index, 5).collect()
    assert len(bounds) == 8 and sum(bound >= min(r["bm25_score"] for r in best) for bound in bounds.values()) == 1
    assert sorted(r["id"] for r in best) == [0, 1, 2, 3, 4]


def test_updates_equal_an_index_from_scratch(spark, questions):
    first = corpus()
    second = [b for b in first if b[0] % 5 != 1] + [(1000 + i, "the new", f"r{i} c1 fresh") for i in range(40)]
    third = [b for b in second if b[0] % 3] + [(2000, "the", "fresh fresh r7")]
    index = postings.indexed(spark.createDataFrame(first, BOOK).repartition(3), block_books=11)
    before = first
    for after in (second, third):
        added = spark.createDataFrame([b for b in after if b not in before] or [(0, "", "")], BOOK)
        removed = spark.createDataFrame([(b[0],) for b in before if b not in after], "id int")
        index = postings.updated(index, added, removed, block_books=11)
        before = after
        scratch = postings.indexed(spark.createDataFrame(after, BOOK))
        assert sorted(map(tuple, index.stats.collect())) == sorted(map(tuple, scratch.stats.collect()))
        assert sorted(r["id"] for r in index.books().collect()) == sorted(b[0] for b in after)
        check(postings.bm25_top(questions, index).collect(), after, 10)
    nothing = postings.updated(index, added.where("false"), removed.where("false"))
    assert sorted(map(tuple, nothing.stats.collect())) == sorted(map(tuple, index.stats.collect()))


def test_statistics_equal_those_of_the_texts(spark):
    df = spark.createDataFrame(corpus(), BOOK)
    assert sorted(map(tuple, postings.indexed(df).stats.collect())) == sorted(map(tuple, retrieval.corpus_stats(df).collect()))


def test_empty_corpus_and_no_questions(spark, questions):
    df = spark.createDataFrame(corpus(), BOOK)
    empty = postings.indexed(df.where("false"))
    assert postings.bm25_top(questions, empty).count() == 0
    assert postings.bm25_top(questions.where("false"), postings.indexed(df)).count() == 0
    pairs = questions.selectExpr("query_id", "1 as id")
    assert postings.pair_scores(pairs, questions, empty).count() == 0


def test_books_that_left_are_taken_out_block_by_block():
    import pyarrow as pa

    rows = [  # (block, term, ids, tfs, lengths, gone); repeated and missing ids, blocks in turn
        (1, "", [1, 2, 2, 3], [0, 0, 0, 0], [5, 6, 7, 8], [2, 9]),
        (1, "a", [2, 3], [4, 1], [6, 8], [2, 9]),
        (2, "b", [2, 9], [1, 2], [3, 4], [9]),
        (1, "c", [2], [1], [7], [2, 9]),
        (2, "", [9, None], [0, 0], [4, 4], [9]),
    ]
    names = ["block", "term", "ids", "tfs", "lengths", "gone"]
    numbers = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.string(), numbers, numbers, numbers, numbers]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    found = [tuple(r.values()) for out in postings._left_over(iter([batch.slice(0, 0), batch])) for r in out.to_pylist()]
    assert found == [
        (1, "", [1, 3], [0, 0], [5, 8], 0, 5, 2, 13),
        (1, "a", [3], [1], [8], 1, 8, 1, 1),
        (2, "b", [2], [1], [3], 1, 3, 1, 1),
        (2, "", [], [], [], 0, 0, 0, 0),
    ]
