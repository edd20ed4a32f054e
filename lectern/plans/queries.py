"""Every operator as a query over the test tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import actions as act
from lectern.functions import text as txt
from lectern.functions import vectors as vec
from lectern.operators import catalogue, policy, postings, registry, retrieval, sessions, triplets, warehouse
from lectern.operators.adapter import apply_adapter, fit_adapter
from lectern.operators.embedding import embed, hashing_encoder
from lectern.plans import domain, jobs
from lectern.plans.dashboard import dashboard_frames, dashboard_points
from lectern.session import small_files_session, streaming_session
from lectern.sources.storage import shared_dir, written
from lectern.sources import sinks
from lectern.sources.tables import read_prompt_log, read_sidecars, read_table, read_triplets_csv
from lectern.streaming import interactions as stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

BATCH_END = 1705363200  # 2024-01-16, the end of the first fact load


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _entries(c: str, *fields: str) -> Column:
    """A list of structs as text, for comparison."""
    return F.array_join(F.transform(c, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ",")


def _numbers(c: str) -> Column:
    """All numbers of a vector, to six places, as a digest."""
    whole = F.transform(c, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    return F.md5(F.array_join(whole, ",").cast("binary"))


# --- warehouse --------------------------------------------------------------------------------------------


def _loads(history: DataFrame, actions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of two incremental loads (the first weeks, then everything), and the rejects of the second."""
    times = warehouse.dim_time(history.sparkSession)
    first, _ = warehouse.load_facts(history.where(F.col("timestamp") < BATCH_END), None, times, actions)
    second, rejects = warehouse.load_facts(history, first, times, actions)
    return first.unionByName(second), rejects


def _ui_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _loads(domain.ui_history(spark, sf), warehouse.dim_action(spark))[0]


def _rec_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _loads(domain.rec_history(spark, sf))[0]


def _outcome(spark: SparkSession, sf: str, ordered: bool = False) -> DataFrame:
    return warehouse.rec_outcome_by_action(
        _rec_facts(spark, sf), _ui_facts(spark, sf), warehouse.dim_time(spark), warehouse.dim_action(spark), ordered
    )


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.interaction_analysis(_ui_facts(spark, sf), warehouse.dim_time(spark), warehouse.dim_action(spark))


def _id_text(df: DataFrame) -> DataFrame:
    """`actionid`, which may be missing, as text: clients disagree on how to show a missing integer."""
    return df.withColumn("actionid", F.col("actionid").cast("string"))


def _epoch(facts: DataFrame) -> DataFrame:
    return facts.withColumn("created_at", F.unix_seconds("created_at"))


@query
def dim_time(spark, sf):
    """Orders per day with the attributes of the day."""
    days = read_table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    times = warehouse.dim_time(spark, dt.date(1990, 1, 1), dt.date(2029, 12, 31))
    return days.join(F.broadcast(times), "date").withColumn("date", F.col("date").cast("string"))


@query
def dim_action(spark, sf):
    """Interactions per action with its id and description, NULL for actions the warehouse does not know."""
    counted = domain.all_history(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("interactions"))
    names = warehouse.dim_action(spark).withColumnRenamed("actionname", "action")
    return _id_text(counted.join(F.broadcast(names), "action", "left"))


@query
def lookup_dims(spark, sf):
    looked = _id_text(
        warehouse.lookup_dims(domain.all_history(spark, sf), warehouse.dim_time(spark), warehouse.dim_action(spark))
    )
    return looked.groupBy("timeid", "actionid").agg(
        F.count(F.lit(1)).alias("events"), F.min(F.unix_seconds("created_at")).alias("first_at")
    )


@query
def fact_interaction_load(spark, sf):
    return _epoch(_ui_facts(spark, sf))


@query
def fact_recommendation_load(spark, sf):
    return _epoch(_rec_facts(spark, sf))


@query
def fact_rejects(spark, sf):
    return _id_text(_epoch(_loads(domain.ui_history(spark, sf), warehouse.dim_action(spark))[1]))


def _warehouse(spark: SparkSession, sf: str) -> str:
    """A warehouse after three loads: the first weeks, everything, and everything again, with bitmaps before each join."""
    lake = shared_dir(spark, "warehouse")
    ui, rec = domain.ui_history(spark, sf), domain.rec_history(spark, sf)
    for part in (ui.where(F.col("timestamp") < BATCH_END), ui, ui):
        jobs.warehouse_etl(spark, part, rec, lake, small_rows=0)
    return lake


@query
def stored_facts(spark, sf):
    return _epoch(jobs.facts(spark, _warehouse(spark, sf), "fact_user_interaction"))


@query
def stored_rejects(spark, sf):
    return _id_text(_epoch(spark.read.parquet(f"{_warehouse(spark, sf)}/fact_user_interaction_rejects")))


@query
def rec_outcomes(spark, sf):
    outcomes = warehouse.rec_outcomes(_rec_facts(spark, sf), _ui_facts(spark, sf))
    return _id_text(outcomes).withColumn("acted", F.coalesce("acted", F.lit(0)))


@query
def rec_outcome_by_action(spark, sf):
    return _outcome(spark, sf, ordered=True).withColumn(
        "recommendation_date", F.col("recommendation_date").cast("string")
    )


@query
def user_interaction_analysis(spark, sf):
    return _analysis(spark, sf)


@query
def actions_per_user_month(spark, sf):
    monthly = warehouse.actions_per_user_month(_analysis(spark, sf))
    return monthly.withColumn("action_per_user", _r("action_per_user"))


@query
def chart_rec_by_action(spark, sf):
    return warehouse.chart_rec_by_action(_outcome(spark, sf)).withColumn(
        "recommendation_date", F.col("recommendation_date").cast("string")
    )


@query
def dashboard(spark, sf):
    frames = dashboard_frames(_outcome(spark, sf), _analysis(spark, sf), domain.model(spark, sf))
    return dashboard_points(frames).withColumn("y", _r("y"))


# --- catalogue --------------------------------------------------------------------------------------------


@query
def catalogue_extract(spark, sf):
    books, _, _ = catalogue.extract_catalogue(domain.source_catalogue(spark, sf))
    return books.select("id", "title", "author", "summary", "image", "pdf_file", "created_date")


@query
def catalogue_tags(spark, sf):
    _, tags, pairs = catalogue.extract_catalogue(domain.source_catalogue(spark, sf))
    return pairs.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("books")).join(tags, "id")


@query
def asset_paths(spark, sf):
    books = domain.source_catalogue(spark, sf)["books"]
    return catalogue.asset_paths(books).select("id", "path", "sidecar", "summary", "image", "pdf_file")


@query
def media_urls(spark, sf):
    books = domain.books(spark, sf, vectors=False, excerpts=True)
    return catalogue.book_cards(books).select("id", "title", "image")


@query
def diff_new_keys(spark, sf):
    return catalogue.new_keys(domain.source_books(spark, sf), domain.target_books(spark, sf), ["id"])


@query
def diff_deleted_keys(spark, sf):
    return catalogue.deleted_keys(domain.source_books(spark, sf), domain.target_books(spark, sf), ["id"])


def _bridge_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bridge = domain.books_tags(spark, sf)
    total = F.col("book_id") + F.col("tag_id")
    return bridge.where(total % 10 != 3), bridge.where(total % 7 != 2)


@query
def diff_composite_key(spark, sf):
    source, target = _bridge_sides(spark, sf)
    return catalogue.diff_keys(source, target, ["book_id", "tag_id"])


@query
def apply_diff_soft(spark, sf):
    source, target = domain.source_books(spark, sf), domain.target_books(spark, sf)
    return catalogue.apply_diff(target, source, ["id"], "soft").select("id", "idx", "title", "active")


@query
def apply_diff_hard(spark, sf):
    source, target = _bridge_sides(spark, sf)
    return catalogue.apply_diff(target, source, ["book_id", "tag_id"], "hard")


@query
def transform_new(spark, sf):
    """New books with the cleaned text of the page of the same number, 'NaN' where there is none."""
    pages = read_table(spark, sf, "pages").select(
        F.col("page_id").cast("int").alias("id"), F.col("html").alias("description")
    )
    source, target = (books(spark, sf, excerpts=True) for books in (domain.source_books, domain.target_books))
    fresh = catalogue.transform_new(source, target, pages)
    return fresh.select(
        "id", "title", "summary",
        F.size("title_embed").alias("title_dim"),
        F.size("summary_embed").alias("summary_dim"),
    )


def _loaded_lake(spark: SparkSession, sf: str) -> str:
    """A catalogue after two snapshots, in id ranges of 500, with the page of the same number as sidecar."""
    source = domain.source_catalogue(spark, sf)
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("description"))
    sidecars = (
        catalogue.asset_paths(source["books"]).join(pages, "id").select(F.col("sidecar").alias("path"), "description")
    )
    lake = shared_dir(spark, "lake")
    link = source["books_tags_link"]
    for kept, tagged in ((F.col("id") % 7 != 2, F.col("book") % 5 != 1), (F.col("id") % 10 != 3, F.col("book") % 4 != 0)):
        snapshot = {**source, "books": source["books"].where(kept), "books_tags_link": link.where(tagged)}
        snapshot["tags"] = source["tags"].where(kept)
        jobs.catalogue_etl(spark, snapshot, sidecars, lake, width=500)
    return lake


@query
def catalogue_etl(spark, sf):
    """The stored books after two snapshots."""
    books = jobs.catalogue_table(spark, _loaded_lake(spark, sf), "books")
    return books.select("id", "idx", "title", "author", "summary", "image", "active", F.size("summary_embed").alias("dim"))


@query
def catalogue_etl_links(spark, sf):
    """The stored tags and book-tag pairs after two snapshots, met on the tag; tags without a book and pairs without a tag, too."""
    lake = _loaded_lake(spark, sf)
    tags, pairs = (jobs.catalogue_table(spark, lake, name) for name in ("tags", "books_tags"))
    named = tags.select(F.col("id").alias("tag_id"), "name", F.size("tag_embed").alias("dim"))
    return pairs.join(named, "tag_id", "full")


@query
def item_positions(spark, sf):
    return sessions.item_index(domain.books(spark, sf, vectors=False))


def _shapes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    books = domain.books(spark, sf, vectors=False).select("id", "title", "image", "author")
    return books, domain.books_tags(spark, sf), domain.tag_names(spark, sf)


@query
def books_with_tags(spark, sf):
    return catalogue.books_with_tags(*_shapes(spark, sf)).withColumn("tags", F.array_join("tags", "|"))


@query
def tags_with_books(spark, sf):
    books, bridge, tags = _shapes(spark, sf)
    nested = catalogue.tags_with_books(tags, bridge, books)
    return nested.select("id", "name", "page", F.explode("books").alias("book")).select(
        "id", "name", "page",
        F.col("book.id").alias("book_id"), F.col("book.title").alias("title"),
        F.array_join("book.tags", "|").alias("tags"),
    )


@query
def tags_of(spark, sf):
    _, bridge, tags = _shapes(spark, sf)
    return catalogue.tags_of(42, bridge, tags)


@query
def books_of(spark, sf):
    books, bridge, _ = _shapes(spark, sf)
    return catalogue.books_of(100, bridge, books)


@query
def search_title(spark, sf):
    books, _, _ = _shapes(spark, sf)
    return catalogue.search(books, " eN 1 ", "title")


@query
def search_author(spark, sf):
    books, _, _ = _shapes(spark, sf)
    return catalogue.search(books, "SRC1", "author")


@query
def search_tags(spark, sf):
    books, bridge, tags = _shapes(spark, sf)
    return catalogue.search(books, "Label_1", "tags", tags, bridge)


@query
def search_blank(spark, sf):
    books, _, _ = _shapes(spark, sf)
    return catalogue.search(books, "  ", "title")


@query
def book_detail(spark, sf):
    books, bridge, tags = _shapes(spark, sf)
    return catalogue.book_detail(books, bridge, tags, 42).withColumn("tags", F.array_join("tags", "|"))


# --- text -------------------------------------------------------------------------------------------------


@query
def clean_html(spark, sf):
    pages = read_table(spark, sf, "pages", spread=True)
    return pages.select("page_id", txt.clean_description(F.col("html")).alias("description"))


@query
def missing_text(spark, sf):
    """Documents with the page of the same number as description: cleaned, and as shown to readers."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html")
    described = docs.join(pages, "doc_id", "left").select(
        "doc_id", txt.clean_description(F.col("html")).alias("summary")
    )
    return described.select(
        "doc_id", "summary",
        txt.no_summary(F.col("summary")).alias("shown"),
        txt.no_summary(F.col("summary"), "No summary available.").alias("prompted"),
    )


@query
def tokenize(spark, sf):
    books = domain.books(spark, sf, vectors=False, spread=True)
    words = retrieval.documents(books)
    return words.select(
        "id",
        F.size("words").alias("words"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        F.md5(F.array_join("words", " ").cast("binary")).alias("digest"),
    )


def _sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, sidecar): every document as a catalogue sidecar; some are cut off, some lack the element."""
    doc = F.col("doc_id")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>t</dc:title>')
    element = F.concat(F.lit("<dc:description>"), escaped, F.lit("</dc:description>"))
    tail = F.lit("</metadata></package>")
    sidecar = (
        F.when(doc % 17 == 0, F.concat(head, element))
        .when(doc % 19 == 0, F.concat(head, tail))
        .otherwise(F.concat(head, element, tail))
    )
    return read_table(spark, sf, "documents").select("doc_id", sidecar.alias("sidecar"))


@query
def xml_description(spark, sf):
    parsed = _sidecars(spark, sf).select("doc_id", txt.xml_description(F.col("sidecar")).alias("description"))
    return parsed.select(
        "doc_id", F.col("description").isNull().alias("absent"),
        txt.clean_description(F.col("description")).alias("summary"),
    )


@query
def sidecar_files(spark, sf):
    """The sidecars written as a file each, and read back."""
    folder = shared_dir(spark, "sidecars")
    sinks.write_texts(_sidecars(spark, sf).withColumnRenamed("doc_id", "doc"), folder, "doc")
    read = read_sidecars(small_files_session(spark), folder, "*.txt")
    return read.select(
        F.regexp_extract("path", "doc=([0-9]+)/", 1).cast("long").alias("doc_id"),
        F.col("description").isNull().alias("absent"), "summary",
    )


def _portable_hash(word: Column) -> Column:
    """A word hash that other engines have as well: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long")


@query
def embed_text(spark, sf):
    """The numbers of each document's vector that are not zero."""
    docs = read_table(spark, sf, "documents", spread=True).select("doc_id", "text")
    embedded = embed(docs, "text", "vector", hashing_encoder(256, _portable_hash))
    numbers = embedded.select("doc_id", F.posexplode("vector").alias("place", "value")).where(F.col("value") != 0)
    return numbers.withColumn("value", _r(F.col("value").cast("double")))


@query
def embed_default(spark, sf):
    """Size and length of each document's vector from the default encoder."""
    docs = read_table(spark, sf, "documents", spread=True).select("doc_id", "text")
    embedded = embed(docs, "text", "vector", hashing_encoder(256))
    length = F.sqrt(vec.dot(F.col("vector"), F.col("vector")))
    return embedded.select("doc_id", F.size("vector").alias("dim"), F.round(length, 4).alias("length"))


# --- sessions ---------------------------------------------------------------------------------------------


@query
def reward_total(spark, sf):
    rated = domain.all_history(spark, sf).withColumn("reward", act.reward(F.col("action")))
    return rated.withColumn("category", act.reward_index(F.col("reward"))).drop("timestamp")


@query
def reward_rejects(spark, sf):
    _, rejects = sessions.reward_strict(domain.ui_history(spark, sf))
    return rejects


@query
def valid_events(spark, sf):
    return sessions.valid_events(domain.ui_history(spark, sf))


@query
def session_order(spark, sf):
    ordered = sessions.session_order(domain.ui_history(spark, sf))
    return ordered.select("sid", "step", "event_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.history_items(domain.ui_history(spark, sf), domain.books(spark, sf, vectors=False))


@query
def history_items(spark, sf):
    return _items(spark, sf).select("sid", "event_id", "bid", "item", "reward")


@query
def session_sequence(spark, sf):
    lists = sessions.session_sequence(_items(spark, sf))
    return lists.select("sid", "first_step", _entries("sequence", "item", "reward").alias("sequence"))


@query
def sliding_state(spark, sf):
    states = sessions.sliding_state(_items(spark, sf))
    return states.select("sid", "step", "item", _entries("state", "item", "reward").alias("state"))


@query
def discounted_return(spark, sf):
    returns = sessions.discounted_return(_items(spark, sf))
    return returns.select("sid", "step", "reward", _r("ret").alias("ret"))


@query
def training_steps(spark, sf):
    steps = sessions.training_steps(domain.ui_history(spark, sf), domain.books(spark, sf, vectors=False))
    return steps.withColumn("state", _entries("state", "item", "reward")).withColumn("ret", _r("ret"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.reward_strict(domain.ui_history(spark, sf))[0]


def _served(last: DataFrame) -> DataFrame:
    return last.select("sid", "event_id", "state_uid", _entries("last", "bid", "reward").alias("last"))


@query
def last5_serving(spark, sf):
    return _served(sessions.last_n(_known(spark, sf)))


@query
def last_state(spark, sf):
    states = sessions.last_state(_known(spark, sf))
    return states.select("sid", "uid", _entries("last", "bid", "reward").alias("last"))


# --- vectors and retrieval --------------------------------------------------------------------------------


@query
def cosine_pairs(spark, sf):
    """Distances between the title and the summary vector of each book."""
    books = domain.books(spark, sf)
    title, summary = F.col("title_embed"), F.col("summary_embed")
    return books.select(
        "id",
        _r(vec.cosine_distance(title, summary)).alias("cosine"),
        _r(vec.l2(title, summary)).alias("l2"),
        _r(vec.dot(title, summary)).alias("dot"),
    )


@query
def vector_text(spark, sf):
    """Vectors written as text and read back, with the weighted distance to themselves."""
    embeddings = read_table(spark, sf, "embeddings")
    parsed = vec.parse_vector(vec.to_json_vector(F.col("embedding")))
    distance = vec.cosine_distance(F.col("embedding"), parsed)
    return embeddings.select(
        "vec_id", F.size(parsed).alias("dim"),
        _r(vec.l2(F.col("embedding"), parsed)).alias("l2"),
        _r(vec.combined(distance, distance)).alias("combined"),
    )


@query
def l2_nearest_tag(spark, sf):
    return triplets.nearest_other(domain.tags(spark, sf)).withColumn("distance", _r("distance"))


@query
def dense_top10(spark, sf):
    found = retrieval.dense_top(domain.queries(spark, sf), domain.books(spark, sf))
    for name in ("title_similarity", "summary_similarity", "combined_similarity"):
        found = found.withColumn(name, _r(name))
    return found


@query
def corpus_stats(spark, sf):
    stats = retrieval.corpus_stats(domain.books(spark, sf, vectors=False, spread=True))
    return retrieval.term_weights(stats).withColumn("idf", _r("idf"))


@query
def corpus_totals(spark, sf):
    stats = retrieval.corpus_stats(domain.books(spark, sf, vectors=False, spread=True))
    return retrieval.corpus_totals(stats).withColumn("avg_length", _r("avg_length"))


def _index(spark: SparkSession, sf: str, excerpts: bool = False) -> postings.Index:
    books = domain.books(spark, sf, vectors=False, spread=True, excerpts=excerpts)
    if excerpts:  # a document without text has no words, whatever stands for its summary
        books = books.withColumn("summary", F.when(F.col("title").isNotNull(), F.col("summary")))
    return postings.indexed(books)


@query
def bm25_scores(spark, sf):
    """The score of every book that shares a word with a question, from stored postings."""
    scored = postings.bm25_all(domain.queries(spark, sf), _index(spark, sf, excerpts=True))
    return scored.withColumn("bm25_score", _r("bm25_score"))


def _updated_index(spark: SparkSession, sf: str) -> postings.Index:
    """Postings of a first snapshot of the books, brought up to date with a second one."""
    source, target = domain.source_books(spark, sf), domain.target_books(spark, sf)
    index = postings.indexed(source)
    fresh = target.join(catalogue.new_keys(target, source, ["id"]), "id", "left_semi")
    return postings.updated(index, fresh, catalogue.deleted_keys(target, source, ["id"]))


@query
def corpus_stats_updated(spark, sf):
    weights = postings.term_weights(_updated_index(spark, sf).stats)
    return weights.withColumn("idf", _r("idf"))


@query
def bm25_updated(spark, sf):
    best = postings.bm25_top(domain.queries(spark, sf), _updated_index(spark, sf))
    return best.withColumn("bm25_score", _r("bm25_score"))


@query
def attach_bm25(spark, sf):
    """The dense candidates with their scores, looked up in the postings."""
    queries, books = domain.queries(spark, sf), domain.books(spark, sf)
    found = written(retrieval.dense_top(queries, books), "candidates")
    scored = retrieval.attach_bm25(found, postings.pair_scores(found, queries, _index(spark, sf)))
    return scored.select("query_id", "id", "dense_rank", _r("bm25_score").alias("bm25_score"))


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(domain.queries(spark, sf), domain.books(spark, sf), index=_index(spark, sf))


@query
def hybrid_search(spark, sf):
    return _suggestions(spark, sf).select(
        "query_id", "rank", "id", "title", "image", "author",
        F.md5(F.col("summary").cast("binary")).alias("summary_digest"),
        "summary_label", "title_label", "combined_label",
        _r("combined_similarity").alias("combined_similarity"),
        _r("bm25_score").alias("bm25_score"),
    )


@query
def prompt_context(spark, sf):
    return retrieval.prompt_context(_suggestions(spark, sf), domain.queries(spark, sf))


@query
def prompt_log(spark, sf):
    """The prompts of all questions, logged and read back."""
    folder = shared_dir(spark, "prompts")
    sinks.append_prompt_log(retrieval.prompt_context(_suggestions(spark, sf), domain.queries(spark, sf)), folder)
    return read_prompt_log(spark, folder)


# --- triplets, adapter, registry --------------------------------------------------------------------------


def _triplets(spark: SparkSession, sf: str) -> DataFrame:
    return triplets.mine_triplets(domain.tags(spark, sf), domain.books_tags(spark, sf), domain.books(spark, sf))


@query
def mine_triplets(spark, sf):
    return _triplets(spark, sf).select(
        "tag_id", "book_id", "neg_id",
        F.col("pos").isNotNull().alias("has_pos"),
        *[_numbers(name).alias(name) for name in ("anchor", "pos", "neg")],
    )


@query
def triplet_csv(spark, sf):
    """The triplets written as text and read back."""
    folder = shared_dir(spark, "triplets")
    sinks.write_triplets_csv(_triplets(spark, sf), folder)
    return read_triplets_csv(spark, folder).select(*[_numbers(name).alias(name) for name in ("anchor", "pos", "neg")])


def _halving_adapter(out: int = 32, dim: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """An adapter that keeps the first `out` numbers of a vector."""
    return np.eye(out, dim), np.zeros(out)


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return triplets.evaluate_triplets(_triplets(spark, sf), *_halving_adapter())


@query
def evaluate_triplets(spark, sf):
    evaluated = _evaluated(spark, sf)
    for name in ("distance_pos", "distance_neg", "adapted_distance_pos", "adapted_distance_neg"):
        evaluated = evaluated.withColumn(name, _r(name))
    return evaluated


@query
def correct_triplets(spark, sf):
    return triplets.correct_triplets(_evaluated(spark, sf))


@query
def adapter_output(spark, sf):
    """Twice the first 16 numbers of each vector plus one, through the adapter."""
    adapted = apply_adapter(
        read_table(spark, sf, "embeddings"), "embedding", 2 * np.eye(16, 64), np.ones(16), "adapted"
    )
    return adapted.select("vec_id", F.posexplode("adapted").alias("place", "value")).withColumn(
        "value", _r(F.col("value").cast("double"), 5)
    )


@query
def fit_adapter_losses(spark, sf):
    _, _, losses = fit_adapter(_triplets(spark, sf))
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query
def latest_model(spark, sf):
    """Every number of the newest artefact of each type."""
    newest = registry.latest_model(domain.model(spark, sf))
    numbers = F.posexplode(F.from_json("weights", "array<double>")).alias("place", "weight")
    return newest.select("type", "id", numbers).withColumn("weight", F.round("weight", 4))


@query
def saved_models(spark, sf):
    """The newest artefact of each type saved to a registry of its own, and read back."""
    folder = shared_dir(spark, "registry")
    newest = registry.latest_model(domain.model(spark, sf)).orderBy("type").collect()  # a row per type
    for row in newest:
        registry.save_model(spark, folder, row["type"], json.loads(row["weights"]), registry.next_id(spark, folder))
    numbers = F.posexplode(F.from_json("weights", "array<double>")).alias("place", "weight")
    return registry.read_registry(spark, folder).select("type", "id", numbers).withColumn("weight", F.round("weight", 4))


@query
def last3_models(spark, sf):
    return registry.last_n_models(domain.model(spark, sf)).select("type", "training_round", "id")


@query
def last3_losses(spark, sf):
    curves = registry.loss_curves(domain.model(spark, sf), "losses")
    return curves.select("training_round", "id", "epoch", F.round("loss", 4).alias("loss"))


@query
def model_metadata(spark, sf):
    return registry.model_metadata(domain.books(spark, sf))


# --- recommender ------------------------------------------------------------------------------------------


def _recommended(spark: SparkSession, sf: str) -> DataFrame:
    items = policy.policy_items(domain.books(spark, sf))
    loaded = policy.load_params(items, policy.initial_params)
    return policy.recommend(sessions.last_state(_known(spark, sf)), loaded)


@query
def recommend_top5(spark, sf):
    return _recommended(spark, sf).withColumn("logit", _r("logit")).withColumn("probability", _r("probability"))


@query
def recommended_books(spark, sf):
    """The books behind each session's recommendations, in rank order."""
    books = domain.books(spark, sf, vectors=False).select("id", "title", "author")
    ranked = _recommended(spark, sf).select("sid", "uid", "rank", "bid")
    return catalogue.recommended_books(ranked, books)


def _fitted(spark: SparkSession, sf: str, **settings: int) -> tuple[DataFrame, list[float], policy.Progress]:
    books = domain.books(spark, sf)
    steps = sessions.training_steps(domain.ui_history(spark, sf), books.drop("title_embed", "summary_embed"))
    return policy.fit_policy(steps, policy.policy_items(books), **settings)


@query
def first_fit_loss(spark, sf):
    """The loss of all steps before the first update: the mean of its one batch, by the number of sessions."""
    _, losses, _ = _fitted(spark, sf, epochs=1, steps_per_epoch=1)
    return spark.createDataFrame([(losses[0],)], "loss double").select(_r("loss", 9).alias("loss"))


@query
def first_fit_update(spark, sf):
    """The clipped gradient of every parameter in an update from all steps, ten times its first mean."""
    params, _, _ = _fitted(spark, sf, epochs=1, steps_per_epoch=1)
    slopes = params.select("id", F.posexplode("mean").alias("place", "slope"))
    return slopes.withColumn("slope", _r(10 * F.col("slope"), 7))


@query
def fit_policy_losses(spark, sf):
    _, losses, _ = _fitted(spark, sf)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query
def event_messages(spark, sf):
    """Events as the messages of a topic, and parsed again."""
    sent = sinks.event_messages(domain.ui_history(spark, sf)).withColumn("event_id", F.monotonically_increasing_id())
    return stream.parse_messages(sent.select("value", "event_id")).drop("event_id")


@query
def created_tables(spark, sf):
    """The history in a created table, loaded twice, with the creation repeated in between."""
    database = f"lectern_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_dir(spark, 'database')}'")
    history = domain.ui_history(spark, sf).select(*[f.name for f in schemas.UI_HISTORY.fields])
    for part in (F.col("timestamp") < BATCH_END, F.col("timestamp") >= BATCH_END):
        schemas.create_tables(spark, database=database)
        history.where(part).write.insertInto(f"{database}.ui_history")
    return spark.table(f"{database}.ui_history")


# --- stream -----------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream of interactions."""
    schema = read_table(spark, sf, "events").schema
    events = stream.file_stream(streaming_session(spark), sf, "events.parquet", schema)
    return domain.history(events).where(F.col("action") != "view")


def _run_to_table(events: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote."""
    spark = events.sparkSession
    folder = shared_dir(spark, name)
    running = (
        events.writeStream.format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/data")


@query
def stream_reward(spark, sf):
    rated = stream.with_reward(_event_stream(spark, sf))
    return _run_to_table(rated.select("event_id", "sid", "bid", "reward"), "stream-reward")


@query
def stream_raw_log(spark, sf):
    """What the raw log holds, read back."""
    events, _ = stream.route(_event_stream(spark, sf))
    folder = shared_dir(spark, "stream-raw")
    stream.raw_log(events, f"{folder}/raw", f"{folder}/checkpoint").awaitTermination()
    logged = events.sparkSession.read.schema(events.schema).json(f"{folder}/raw")
    return logged.select("event_id", "sid", "uid", "bid", "action")


@query
def stream_drain(spark, sf):
    """The raw log drained into the history table."""
    events = _event_stream(spark, sf)
    session, folder = events.sparkSession, shared_dir(spark, "stream-drain")
    stream.raw_log(events, f"{folder}/raw", f"{folder}/checkpoint").awaitTermination()
    stream.drain_log(session, f"{folder}/raw", f"{folder}/history", f"{folder}/drained")
    return session.read.schema(schemas.UI_HISTORY).parquet(f"{folder}/history")


@query
def stream_last5(spark, sf):
    return _served(_run_to_table(stream.session_last5(_event_stream(spark, sf)), "stream-last5"))


DAY = 86_400


@query
def last5_since_silence(spark, sf):
    """Sessions start anew after a day without an event."""
    return _served(sessions.last_n(_known(spark, sf), silence=DAY))


@query
def stream_since_silence(spark, sf):
    return _served(_run_to_table(stream.session_last5(_event_stream(spark, sf), silence=DAY), "stream-silence"))


def _resumed(spark: SparkSession, sf: str) -> tuple[SparkSession, str]:
    """The stream served in two runs over two files of events, the second one going on where the first stopped."""
    session, folder = streaming_session(spark), shared_dir(spark, "stream-resumed")
    events = read_table(session, sf, "events")
    items = policy.policy_items(domain.books(session, sf))
    early = F.col("timestamp") < BATCH_END
    for name, part in (("early", early), ("late", ~early)):
        history = domain.history(events).where(F.col("action") != "view")
        history.where(part).coalesce(1).write.parquet(f"{folder}/in/{name}")
        source = session.readStream.schema(history.schema).parquet(f"{folder}/in/*")
        stream.run_stream(source, items, policy.initial_params, folder)
    return session, folder


@query
def stream_resumed(spark, sf):
    """The latest list of each user, by the log of a stream that was stopped and resumed and by its table of lists."""
    session, folder = _resumed(spark, sf)
    ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "bid"))), lambda r: r["bid"]), ",")
    logged = stream.rec_log(session, folder).groupBy("uid", "event_id").agg(ranked.alias("bids"))
    newest = logged.groupBy("uid").agg(F.max_by("bids", "event_id").alias("logged"))
    latest = stream.latest_recs(session, folder).withColumn("bids", F.array_join("bids", ","))
    return latest.join(newest, "uid", "full")


@query
def stream_rejects(spark, sf):
    """Events whose action has no reward, as the served stream logs them."""
    session, folder = _resumed(spark, sf)
    return stream.served_log(session, folder, "rejects").select("event_id", "sid", "uid", "bid", "action")


@query
def stream_recommend(spark, sf):
    """The latest list of each user after the whole stream was served."""
    events = _event_stream(spark, sf)
    session = events.sparkSession
    items = policy.policy_items(domain.books(session, sf))
    folder = shared_dir(spark, "stream-serve")
    stream.run_stream(events, items, policy.initial_params, folder)
    return stream.latest_recs(session, folder).withColumn("bids", F.array_join("bids", ","))
