"""Catalogue snapshots: extract, diff, apply; and the shapes the catalogue is read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import clean_description, media_url
from lectern.operators.embedding import Encoder, embed, hashing_encoder
from lectern.operators.skew import dense_positions, fits, hot_join, join_checked
from lectern.sources.storage import written

# --- extract ----------------------------------------------------------------------------------------------


def asset_paths(books: DataFrame) -> DataFrame:
    """Locations of the sidecar, cover and document files below `path`, quotes replaced for use in a URL.

    `sidecar` keeps the quote: it is the file to open.
    """
    def located(suffix: str) -> Column:
        return F.translate(F.concat(F.col("path"), F.lit(suffix)), "'", "_")

    return books.select(
        "*",
        F.concat(F.col("path"), F.lit("/metadata.opf")).alias("sidecar"),
        located("/metadata.opf").alias("summary"),
        located("/cover.jpg").alias("image"),
        located("/*.pdf").alias("pdf_file"),
    )


def authors_joined(books: DataFrame, link: DataFrame, authors: DataFrame) -> DataFrame:
    """Books with their author names joined by ', '; a book without author is left out.

    Names are joined per book before the books are met, so the book columns move once.
    """
    names = join_checked(
        link.select("book", F.col("author").alias("_author")),
        authors.select(F.col("id").alias("_author"), "name"),
        ["_author"],
    )
    listed = names.groupBy(F.col("book").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("author")
    )
    return books.join(listed, "id")


def extract_catalogue(source: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, tags and book-tag pairs of an external catalogue in the shape of the target tables."""
    books = asset_paths(authors_joined(source["books"], source["books_authors_link"], source["authors"]))
    extracted = books.select(
        "id", "title", "summary", "image", "pdf_file", "author", "sidecar",
        F.col("timestamp").alias("created_date"),
        F.col("pubdate").alias("published_date"),
    )
    tags = source["tags"].select("id", "name")
    pairs = source["books_tags_link"].select(F.col("book").alias("book_id"), F.col("tag").alias("tag_id"))
    return extracted, tags, pairs


# --- diff and apply ---------------------------------------------------------------------------------------


def diff_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only: `change` is 'new' (source) or 'deleted' (target).

    One pass over both sides: keys are reduced where they are read, then meet in one shuffle. Only keys are compared.
    """
    sides = source.select(*keys, F.lit(True).alias("_source")).unionByName(
        target.select(*keys, F.lit(False).alias("_source"))
    )
    seen = sides.groupBy(*keys).agg(F.max("_source").alias("_in_source"), F.min("_source").alias("_not_in_target"))
    return seen.where(F.col("_in_source") == F.col("_not_in_target")).select(
        *keys, F.when(F.col("_in_source"), "new").otherwise("deleted").alias("change")
    )


def new_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return diff_keys(source, target, keys).where(F.col("change") == "new").drop("change")


def deleted_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return diff_keys(source, target, keys).where(F.col("change") == "deleted").drop("change")


def new_rows(source: DataFrame, target: DataFrame, keys: list[str], changes: DataFrame | None = None) -> DataFrame:
    """Source rows whose key the target does not have, active or not.

    Keys are compared on their own and written once; wide rows move only when the new keys are too many to broadcast.
    `changes` are the differences of the keys, where they are known already.
    """
    fresh = written(new_keys(source, target, keys), "new") if changes is None else _changed(changes, "new")
    return join_checked(source, fresh, keys, "left_semi")


def _changed(changes: DataFrame, kind: str) -> DataFrame:
    return changes.where(F.col("change") == kind).drop("change")


def transform_new(
    source: DataFrame,
    target: DataFrame,
    descriptions: DataFrame,
    encoder: Encoder | None = None,
    changes: DataFrame | None = None,
) -> DataFrame:
    """Only the new books, with cleaned summary and both vectors.

    `descriptions` has (id, description); a book without one gets the missing-text mark. The anti join comes
    first, so the encoder never sees a book that is already stored.
    """
    encoder = encoder or hashing_encoder()
    fresh = new_rows(source, target, ["id"], changes).drop("summary")
    described = fresh.join(descriptions.select("id", "description"), "id", "left")
    cleaned = described.withColumn("summary", clean_description(F.col("description"))).drop("description")
    return embed(embed(cleaned, "summary", "summary_embed", encoder), "title", "title_embed", encoder)


def _numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """`rows`, which may be wide, with their position in the order of `key`; rows whose key is NULL are left out.

    Only keys are sorted. The rows meet the positions of their keys as they pass; where keys repeat after all, which is
    looked for, the rows are sorted themselves.
    """
    if rows.schema[key].dataType != T.IntegerType():
        return dense_positions(rows, key, out)
    placed = written(dense_positions(rows.select(key), key, out), "positions")
    if not placed.groupBy(key).count().where("count > 1").isEmpty():
        return dense_positions(rows, key, out)
    return rows.join(F.broadcast(placed) if fits(placed) else placed.hint("shuffle_hash"), key)


def apply_diff(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    mode: str,
    fresh: DataFrame | None = None,
    changes: DataFrame | None = None,
    last: int | None = None,
) -> DataFrame:
    """The target after a snapshot: new rows appended, rows gone from the source marked or dropped.

    mode 'soft' sets `active` to false and numbers new rows after the largest `idx`; a row that is inactive stays so,
    even when its key comes back. mode 'hard' drops rows. `fresh` are the prepared new rows when they
    differ from the source rows. Only keys are shuffled; target rows stay in place while the changes are few enough to
    broadcast. Where `target` is a part of a table, `changes` are those of the part and `last` is the largest `idx`
    of the whole.
    """
    changes = written(diff_keys(source, target, keys), "changes") if changes is None else changes
    gone = _changed(changes, "deleted")
    if fresh is None:
        fresh = join_checked(source, _changed(changes, "new"), keys, "left_semi")
    if mode == "hard":
        kept = join_checked(target, gone, keys, "left_anti")
        return kept.unionByName(fresh.select(*kept.columns))
    if mode != "soft":
        raise ValueError(f"mode is 'soft' or 'hard', not {mode!r}")
    kept = (
        join_checked(target, gone.withColumn("_gone", F.lit(True)), keys, "left")
        .withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active")))
        .select(*target.columns)
    )
    before = target.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last")).scalar() if last is None else F.lit(last)
    numbered = (
        _numbered(fresh, keys[0], "_position")
        .withColumn("idx", (F.col("_position") + 1 + before).cast("int"))
        .withColumn("active", F.lit(True))
    )
    return kept.unionByName(numbered.select(*target.columns))


# --- read shapes ------------------------------------------------------------------------------------------


def tags_of(book_id: int, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    mine = bridge.where(F.col("book_id") == book_id).select(F.col("tag_id").alias("id"))
    return tags.join(mine, "id", "left_semi")


def books_of(tag_id: int, bridge: DataFrame, books: DataFrame) -> DataFrame:
    mine = bridge.where(F.col("tag_id") == tag_id).select(F.col("book_id").alias("id"))
    return books.join(mine, "id", "left_semi")


def _tag_lists(bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """(id of the book, tags): the names of its tags, in order; no longer than the tag table.

    Repeated pairs are dropped inside the grouping, before rows move.
    """
    pairs = bridge.select(F.col("book_id").alias("id"), "tag_id")
    named = join_checked(pairs, tags.select(F.col("id").alias("tag_id"), "name"), ["tag_id"])
    listed = F.sort_array(F.collect_set(F.struct("name", "tag_id")))
    return named.groupBy("id").agg(F.transform(listed, lambda tag: tag["name"]).alias("tags"))


def books_with_tags(books: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """Each book with the list of its tag names, empty when it has none."""
    return books.join(_tag_lists(bridge, tags), "id", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def tags_with_books(
    tags: DataFrame, bridge: DataFrame, books: DataFrame, page_ids: int = 1_000
) -> DataFrame:
    """Each tag with its books, every book with its own tag list: (id, name, page, books).

    A tag may hold a large share of all books, so its books come in pages of `page_ids` consecutive book ids. A tag
    without books has one row with an empty list.
    """
    shaped = books_with_tags(books, bridge, tags)
    entry = F.struct(*[F.col(c) for c in ["id", *[c for c in shaped.columns if c != "id"]]])
    nested = shaped.select(F.col("id").alias("book_id"), entry.alias("_book"))
    pages = (
        bridge.select("tag_id", "book_id").distinct()
        .join(nested, "book_id")
        .withColumn("page", F.floor(F.col("book_id") / F.lit(page_ids)).cast("int"))
        .groupBy("tag_id", "page")
        .agg(F.sort_array(F.collect_list("_book")).alias("books"))
    )
    named = tags.select("id", "name")
    filled = join_checked(pages.withColumnRenamed("tag_id", "id"), named, ["id"]).select("id", "name", "page", "books")
    empty = F.array().cast(pages.schema["books"].dataType)
    alone = named.join(filled_ids(bridge, nested), "id", "left_anti")
    return filled.unionByName(alone.select("id", "name", F.lit(0).alias("page"), empty.alias("books")))


def filled_ids(bridge: DataFrame, nested: DataFrame) -> DataFrame:
    """Ids of the tags that have a known book, counted down to one row per tag before they move."""
    known = bridge.join(nested.select("book_id"), "book_id", "left_semi")
    return known.select(F.col("tag_id").alias("id")).distinct()


def _contains(c: Column, query: str) -> Column:
    return F.contains(F.upper(c), F.upper(F.lit(query)))


def search(
    books: DataFrame,
    query: str = "",
    search_type: str = "",
    tags: DataFrame | None = None,
    bridge: DataFrame | None = None,
) -> DataFrame:
    """Keyword search, ignoring case, in 'title', 'author' or 'tags'; a blank query or type finds everything."""
    query, search_type = query.strip(), search_type.strip()
    if not query or search_type not in ("title", "author", "tags"):
        return books
    if search_type != "tags":
        return books.where(_contains(F.col(search_type), query))
    matching = tags.where(_contains(F.col("name"), query)).select(F.col("id").alias("tag_id"))
    tagged = bridge.join(matching, "tag_id", "left_semi").select(F.col("book_id").alias("id")).distinct()
    return books.join(tagged, "id", "left_semi")


def book_detail(books: DataFrame, bridge: DataFrame, tags: DataFrame, book_id: int) -> DataFrame:
    """One book with its tags and image path; no row when there is no such book."""
    book = books.where(F.col("id") == book_id)
    mine = bridge.where(F.col("book_id") == book_id)
    prefixed = F.concat(F.lit("/media/calibre-library-image/"), F.col("image"))
    return books_with_tags(book, mine, tags).withColumn("image", prefixed)


def book_cards(books: DataFrame) -> DataFrame:
    """Books as a list shows them: image as public path, NULL when there is none."""
    return books.withColumn("image", media_url(F.col("image")))


def recommended_books(recommended: DataFrame, books: DataFrame) -> DataFrame:
    """(uid, rank, bid) with the books they name; unknown books are skipped and ranks are kept.

    A popular book may stand in many lists, so its rows are kept from meeting in one task.
    """
    return hot_join(recommended, books.withColumnRenamed("id", "bid"), ["bid"], "inner")

