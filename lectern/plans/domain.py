"""The domain tables, derived from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import read_table


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def history(events: DataFrame) -> DataFrame:
    """All interactions: a session is a user's week, an item is the event key modulo 25."""
    action = (
        F.when(F.col("event_type") == "purchase", "read")
        .when(F.col("event_type") == "error", "skip")
        .otherwise(F.col("event_type"))
    )
    week = F.date_format(F.date_trunc("week", F.col("ts")), "yyyyMMdd")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), week).alias("sid"),
        F.col("user_id").cast("int").alias("uid"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(25)).alias("bid"),
        action.alias("action"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("timestamp"),
        "event_id",
    )


def all_history(spark: SparkSession, sf: str) -> DataFrame:
    return history(_table(spark, sf, "events"))


def ui_history(spark: SparkSession, sf: str) -> DataFrame:
    return all_history(spark, sf).where(F.col("action") != "view")


def rec_history(spark: SparkSession, sf: str) -> DataFrame:
    return all_history(spark, sf).where(F.col("action") == "view").drop("action")


def books(
    spark: SparkSession, sf: str, vectors: bool = True, spread: bool = False, excerpts: bool = False
) -> DataFrame:
    """One book per document; titled by language, number and source, or with `excerpts` by the start of its text; idx leaves gaps, some summaries and images are missing. `spread` for work on the texts."""
    doc = F.col("doc_id")
    title = F.substring("text", 1, 40) if excerpts else F.concat_ws(" ", "lang", doc.cast("string"), "source")
    docs = read_table(spark, sf, "documents", spread).select(
        (2 * doc + 1).cast("int").alias("idx"),
        doc.cast("int").alias("id"),
        title.alias("title"),
        F.when(doc % 13 == 0, F.lit("NaN")).otherwise(F.col("text")).alias("summary"),
        F.when(doc % 11 == 0, F.lit("")).otherwise(
            F.concat(F.col("source"), F.lit("/"), doc.cast("string"), F.lit("/cover.jpg"))
        ).alias("image"),
        F.col("source").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), doc.cast("int")).alias("published_date"),
        F.lit(True).alias("active"),
    )
    if not vectors:
        return docs
    embeddings = _table(spark, sf, "embeddings")
    summary = embeddings.select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("summary_embed"))
    title = embeddings.select(
        (F.col("vec_id") - 1).cast("int").alias("id"), F.col("embedding").alias("title_embed")
    )
    return docs.join(title, "id", "left").join(summary, "id", "left")


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """One tag per label and one per language, each with the vector of its least id."""
    embeddings = _table(spark, sf, "embeddings")
    by_label = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("tag_embed")).select(
        (F.col("label") + 1).alias("id"), F.concat(F.lit("label_"), F.col("label")).alias("name"), "tag_embed"
    )
    vectors = embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    langs = (
        _table(spark, sf, "documents").select("doc_id", "lang").join(vectors, "doc_id", "left")
        .groupBy("lang")
        .agg(F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("doc_id"))).alias("tag_embed"))
    )
    # The rank of a language counts the languages sorting before it; there are a handful.
    names = langs.agg(F.sort_array(F.collect_set("lang")).alias("names"))
    rank = F.array_position(names.scalar(), F.col("lang"))
    by_lang = langs.select(
        (F.lit(99) + rank).cast("int").alias("id"), F.concat(F.lit("lang_"), F.col("lang")).alias("name"), "tag_embed"
    )
    return by_label.unionByName(by_lang)


def tag_names(spark: SparkSession, sf: str) -> DataFrame:
    return tags(spark, sf).select("id", "name")


def books_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A label tag for each document with a vector, a language tag for every document."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang")
    labelled = docs.join(
        _table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id"
    ).select(F.col("doc_id").cast("int").alias("book_id"), (F.col("label") + 1).alias("tag_id"))
    names = docs.agg(F.sort_array(F.collect_set("lang")).alias("names"))
    spoken = docs.select(
        F.col("doc_id").cast("int").alias("book_id"),
        (F.lit(99) + F.array_position(names.scalar(), F.col("lang"))).cast("int").alias("tag_id"),
    )
    return labelled.unionByName(spoken)


def source_books(spark: SparkSession, sf: str, excerpts: bool = False) -> DataFrame:
    return books(spark, sf, vectors=False, excerpts=excerpts).where(F.col("id") % 10 != 3)


def target_books(spark: SparkSession, sf: str, excerpts: bool = False) -> DataFrame:
    return books(spark, sf, vectors=False, excerpts=excerpts).where(F.col("id") % 7 != 2)


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: the benchmark texts, each with the vector of the same id."""
    texts = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embed")
    )
    return texts.join(vectors, "query_id", "left")


def model(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows from orders: six artefact types, three-epoch loss curves."""
    kinds = F.array(*[F.lit(k) for k in ("weights", "optim", "metadata", "losses", "adapter", "adapter_losses")])
    price = F.col("o_totalprice")
    return _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("type"),
        F.to_json(F.array(price, price / 2, price / 4)).alias("weights"),
        F.col("o_orderdate").alias("timestamp"),
    )


def source_catalogue(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The five tables of an external catalogue: parts are books, suppliers are authors."""
    part = _table(spark, sf, "part")
    path = F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("'s "), F.col("p_partkey").cast("string"))
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return {
        "books": part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
            F.lit(1704067200).cast("long").alias("timestamp"),
            F.lit("2024-01-01").cast("date").alias("pubdate"), path.alias("path"),
        ),
        "authors": _table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
        ),
        "books_authors_link": _table(spark, sf, "lineitem").select(
            F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("author")
        ).distinct(),
        "tags": part.select(brand.alias("id"), F.col("p_brand").alias("name")).distinct(),
        "books_tags_link": part.select(F.col("p_partkey").alias("book"), brand.alias("tag")),
    }
