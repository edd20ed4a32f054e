"""Queries that once did less than their whole job."""

from lectern.plans.queries import QUERIES


def titles(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: None if r["text"] is None else r["text"][:40] for r in texts}


def test_media_urls_title_books_by_their_texts(spark, small):
    found = {r["id"]: r["title"] for r in QUERIES["media_urls"](spark, small).collect()}
    assert found == titles(spark, small)


def test_transform_new_titles_books_by_their_texts(spark, small):
    found = {r["id"]: r["title"] for r in QUERIES["transform_new"](spark, small).collect()}
    assert found and found == {number: title for number, title in titles(spark, small).items() if number in found}


def test_bm25_scores_keep_all_pairs(spark, small):
    found = QUERIES["bm25_scores"](spark, small)
    most = found.groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert found.columns == ["query_id", "id", "bm25_score"] and most > 10
