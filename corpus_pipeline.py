"""A corpus made ready for training: five stages over whole documents, each on all that the one before it kept.

What a stage stages is removed when a later stage starts that does not read it: by then the output is written. Decisions about
rows are taken in the stage; the table it returns only leaves rows out, or repeats them, where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, exact, jaccard, mixing, toxicity
from lectern.llm.data import table
from lectern.sources.storage import noted, remove, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


BATCH_ROWS = 1_000
ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_staged: dict[str, list[str]] = {}  # by application: folders that earlier stages left


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows go to Python at a time: documents are wide, and all stages share one executor's memory."""
    before = spark.conf.get(ROWS_OF_A_BATCH)
    spark.conf.set(ROWS_OF_A_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(ROWS_OF_A_BATCH, before)


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what earlier ones staged, and remembers what it stages itself."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = docs.inputFiles()
        old = _staged.pop(app, [])
        used = [folder for folder in old if any(folder.removeprefix("file:").lstrip("/") in file for file in read)]
        for folder in old:
            if not used:  # a table that is not written yet may read all of them
                remove(spark, folder)
        with noted() as folders, small_batches(spark):
            out = stage(spark, docs, sf_dir)
        _staged[app] = (old if used else []) + folders
        return out

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@staged
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score of operator 4 rejects go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


@staged
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (operator 10)."""
    return exact.without_copies(docs)


@staged
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the smallest id stays (operator 6)."""
    return jaccard.without_near_copies(docs)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of operator 3 takes them."""
    return mixing.mixed_documents(docs)


@staged
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by operator 5: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return written(bpe.round_trip(docs, TOKENIZER), "digests")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]

# Learned scores, hashed order and merges are not SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; the documents between them are removed once the next ones are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with noted() as folders:
            docs = written(made, name)
        for folder in before:
            remove(spark, folder)
        before = folders
    return docs
