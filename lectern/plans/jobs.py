"""The scheduled jobs, over a folder of tables (the lake): catalogue load, warehouse load, training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.actions import epoch_date
from lectern.operators import catalogue, policy, registry, sessions, triplets, warehouse
from lectern.operators.adapter import apply_adapter, fit_adapter
from lectern.operators.embedding import Encoder, embed, hashing_encoder
from lectern.operators.skew import SMALL_ROWS, fits
from lectern.sources import buckets
from lectern.sources.sinks import append, append_facts
from lectern.sources.storage import exists, written

BUCKET_WIDTH = 1_000_000  # ids of a bucket of the catalogue tables
KEYS = {"books": ["id"], "tags": ["id"], "books_tags": ["book_id", "tag_id"]}


def catalogue_table(spark: SparkSession, lake: str, name: str, touched: list[int] | None = None) -> DataFrame:
    """A table of the catalogue as it is now, or the named buckets of it; empty before the first load."""
    return buckets.current(spark, f"{lake}/{name}", schemas.TABLES[name], touched)


def sidecar_descriptions(books: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(id, description) of the books whose sidecar file was found."""
    files = sidecars.select(F.col("path").alias("sidecar"), "description")
    return books.select("id", "sidecar").join(files, "sidecar").select("id", "description")


def catalogue_etl(
    spark: SparkSession,
    source: dict[str, DataFrame],
    sidecars: DataFrame,
    lake: str,
    encoder: Encoder | None = None,
    width: int = BUCKET_WIDTH,
) -> None:
    """One snapshot of the external catalogue into books, tags and books_tags.

    Only new books and tags are cleaned and embedded, and only the id ranges that hold a change are read as a whole and
    written. A book without a readable sidecar gets the missing-text mark. The snapshot is read from its source
    once and staged.
    """
    encoder = encoder or hashing_encoder()
    books, tags, pairs = catalogue.extract_catalogue(source)
    books = written(books.withColumn("id", F.col("id").cast("int")), "snapshot")
    tags = tags.withColumn("id", F.col("id").cast("int"))
    pairs = pairs.select(*[F.col(f.name).cast(f.dataType) for f in schemas.BOOKS_TAGS.fields])

    def fresh_books(changes: DataFrame, target: DataFrame) -> DataFrame:
        described = sidecar_descriptions(books, sidecars)
        fresh = catalogue.transform_new(books, target, described, encoder, changes)
        return fresh.withColumn("modified_date", F.current_timestamp()).select(
            *[F.col(f.name).cast(f.dataType) for f in schemas.BOOKS.fields if f.name not in ("idx", "active")]
        )

    def fresh_tags(changes: DataFrame, target: DataFrame) -> DataFrame:
        return embed(catalogue.new_rows(tags, target, ["id"], changes), "name", "tag_embed", encoder)

    _load(spark, lake, "books", books, "soft", width, fresh_books)
    _load(spark, lake, "tags", tags, "hard", width, fresh_tags)
    _load(spark, lake, "books_tags", pairs, "hard", width)


def _load(
    spark: SparkSession,
    lake: str,
    name: str,
    snapshot: DataFrame,
    mode: str,
    width: int,
    prepared: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> None:
    """Bring a table of the catalogue to a snapshot. Its keys are compared once; buckets without a change stay."""
    keys, whole = KEYS[name], catalogue_table(spark, lake, name)
    changes = catalogue.diff_keys(snapshot, whole, keys)
    if mode == "soft":  # rows that are inactive already do not change again
        active = whole.where("active").select(*keys)
        gone = changes.where(F.col("change") == "deleted").join(active, keys, "left_semi")
        changes = changes.where(F.col("change") == "new").unionByName(gone)
    changes = written(changes, "changes")
    bucket = buckets.id_range(keys[0], width)
    touched = buckets.touched_by(changes, bucket)
    if not touched:
        return
    target = catalogue_table(spark, lake, name, touched)
    last = whole.agg(F.max("idx")).first()[0] or 0 if mode == "soft" else None
    fresh = prepared(changes, target) if prepared else None
    loaded = catalogue.apply_diff(target, snapshot, keys, mode, fresh, changes, last)
    buckets.replace(loaded.select(*[f.name for f in schemas.TABLES[name].fields]), bucket, f"{lake}/{name}", touched)


def warehouse_etl(spark: SparkSession, ui: DataFrame, rec: DataFrame, lake: str, small_rows: int = SMALL_ROWS) -> None:
    """Append the facts of the history tables that are not stored yet, and the rejects that are not stored yet.

    What is stored already is told by the tables themselves, so a load may be repeated. New rows are found once, staged,
    and split where they are read. Of more than `small_rows` stored facts in the months of a load, only those that a
    bitmap of the loaded keys lets through are shuffled.
    """
    times, actions = warehouse.dim_time(spark), warehouse.dim_action(spark)
    for name, history, names in (("fact_user_interaction", ui, actions), ("fact_recommendation", rec, None)):
        path = f"{lake}/{name}"
        stored = _months_of(history, spark.read.parquet(path)).drop("month") if exists(spark, path) else None
        looked = written(warehouse.lookup_dims(history, times, names), "looked")
        large = stored is not None and not fits(stored, small_rows)
        fresh = looked if stored is None else written(warehouse.new_facts(looked, stored, large=large), "fresh")
        facts, rejects = warehouse.split_facts(fresh)
        append_facts(facts, path)
        if exists(spark, f"{path}_rejects"):
            rejects = warehouse.new_rejects(rejects, spark.read.parquet(f"{path}_rejects"))
        append(written(rejects, "rejects"), f"{path}_rejects")


def _months_of(history: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored facts in the month folders that the history touches; no other folder is read."""
    months = history.agg(
        *[F.date_format(epoch_date(f(F.col("timestamp"))), "yyyy-MM").alias(f.__name__) for f in (F.min, F.max)]
    )
    return stored.where(
        (F.col("month") >= months.select("min").scalar()) & (F.col("month") <= months.select("max").scalar())
    )


def facts(spark: SparkSession, lake: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{lake}/{name}").drop("month")


def train_adapter(spark: SparkSession, lake: str, **settings: object) -> list[float]:
    """Mine triplets from the current catalogue, fit the adapter, store it and its losses."""
    books, tags, pairs = (catalogue_table(spark, lake, name) for name in ("books", "tags", "books_tags"))
    mined = triplets.mine_triplets(tags, pairs, books)
    weights, bias, losses = fit_adapter(mined, **settings)
    path = f"{lake}/model"
    number = registry.next_id(spark, path)
    registry.save_model(spark, path, "adapter_losses", losses, number)
    registry.save_model(spark, path, "adapter", {"weight": weights.tolist(), "bias": bias.tolist()}, number + 1)
    return losses


def adapted_books(spark: SparkSession, lake: str) -> DataFrame:
    """Current books with `vector`, the summary vector through the newest adapter."""
    books = catalogue_table(spark, lake, "books")
    adapter = registry.latest_payload(registry.read_registry(spark, f"{lake}/model"), "adapter")
    if adapter is None:
        raise LookupError("no adapter has been trained")
    return apply_adapter(books, "summary_embed", np.array(adapter["weight"]), np.array(adapter["bias"]), "vector")


def train_policy(spark: SparkSession, ui: DataFrame, lake: str, **settings: object) -> list[float]:
    """Fit the policy on all sessions, going on from the newest parameters and optimiser state where they fit.

    Parameters and moments go to a table by item id, the rest to the registry. Books that are new since start at zeros;
    an adapter of another length starts afresh.
    """
    books = adapted_books(spark, lake)
    steps = sessions.training_steps(ui, books.select("id", "idx"))
    path = f"{lake}/model"
    start, progress = earlier_fit(spark, lake, books)
    params, losses, progress = policy.fit_policy(
        steps, policy.policy_items(books, "vector"), start=start, progress=progress, **settings
    )
    number = registry.next_id(spark, path)
    stored = f"{lake}/policy/id={number}"  # a folder of its own: models that are served stay readable
    params.write.parquet(stored)
    metadata = registry.model_metadata(books.drop("summary_embed").withColumnRenamed("vector", "summary_embed")).first()
    registry.save_model(spark, path, "metadata", metadata.asDict(), number + 1)
    registry.save_model(spark, path, "losses", losses, number + 2)
    registry.save_model(spark, path, "optim", asdict(progress), number + 3)
    registry.save_model(spark, path, "weights", {"path": stored}, number)
    return losses


def earlier_fit(spark: SparkSession, lake: str, books: DataFrame) -> tuple[DataFrame | None, policy.Progress]:
    """Parameters and progress of the newest training, nothing where there is none or its vectors had another length."""
    model = registry.read_registry(spark, f"{lake}/model")
    weights, optim = (registry.latest_payload(model, kind) for kind in ("weights", "optim"))
    if weights is None or optim is None:
        return None, policy.Progress()
    stored = spark.read.parquet(weights["path"])
    lengths = [
        df.agg(F.max(F.size(column))).first()[0] for df, column in ((stored, "theta"), (books, "vector"))
    ]
    return (stored, policy.Progress(**optim)) if lengths[0] == lengths[1] + 1 else (None, policy.Progress())


def serving_model(spark: SparkSession, lake: str) -> tuple[DataFrame, DataFrame]:
    """Items and parameters for scoring; an item without trained parameters, say a new book, starts from its vector."""
    items = policy.policy_items(adapted_books(spark, lake), "vector")
    newest = registry.latest_payload(registry.read_registry(spark, f"{lake}/model"), "weights")
    if newest is None:
        raise LookupError("no policy has been trained")
    trained = spark.read.parquet(newest["path"]).select("id", F.col("theta").alias("_trained"))
    params = policy.initial_params(items).join(trained, "id", "left")
    return items, params.select("id", F.coalesce("_trained", "theta").alias("theta"))
