"""Exact duplicates by a split of heavy hitters.

A Misra-Gries summary of every task finds the digests that may be frequent. Merged, at most `counters` candidates are
left, any digest that holds more than one of `counters + 1` rows among them; their exact counts and winners are taken
in one aggregation over few keys, and verified ones are broadcast, so that rows of frequent digests are decided where
they lie. All other digests hold a small share each and meet in an ordinary shuffle of (id, digest) rows. Texts
do not move: rows that go are told to the others as bits (see `rows`).

Defined results: NULL text counts as empty; the row with the largest id stays, NULL being the smallest; of rows that
repeat with that id, one stays, whichever the staged table lists last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrays import releasing
from lectern.llm.data import text_of
from lectern.llm.rows import numbered, without
from lectern.sources.storage import written

COUNTERS = 1_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text_of(text)).cast("binary"), 256))


def reduced(counts: Counter, counters: int) -> Counter:
    """The mergeable form of a summary: less the count that the first one too many has, at most `counters` are left."""
    if len(counts) <= counters:
        return counts
    over = counts.most_common(counters + 1)
    return Counter({key: n - over[-1][1] for key, n in over if n > over[-1][1]})


def summaries(digests: DataFrame, counters: int) -> DataFrame:
    """(digest, least) rows, at most `counters` a task: how often each was seen, too low by no more than a share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for entry in pc.value_counts(batch.column(0)).to_pylist():
                counts[entry["values"]] += entry["counts"]
            counts = reduced(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(counts), pa.binary()), "least": pa.array(list(counts.values()), pa.int64())}
        )

    return digests.select("digest").mapInArrow(releasing(task), "digest binary, least long")


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that hold more than one of `counters` rows, counted exactly, with the row that wins: at most `counters`."""
    merged = summaries(rows, counters).groupBy("digest").agg(F.sum("least").alias("least"))
    candidates = merged.orderBy(F.desc("least"), "digest").limit(counters).select("digest")
    verified = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("best"))
    )
    enough = rows.count() / counters
    found = verified.where(F.col("group_size") > enough)
    return written(found, "frequent")  # rows handed over as a Python list would start more workers on every executor


def decided(staged: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(id, row, digest, group_size, best) of written (id, digest, row) rows; `best` is the (id, row) that stays."""
    heavy = frequent(staged, counters)
    same = Window.partitionBy("digest")
    rest = staged.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "id",
        "row",
        "digest",
        F.count(F.lit(1)).over(same).alias("group_size"),
        F.max(F.struct("id", "row")).over(same).alias("best"),
    )
    winners = staged.join(F.broadcast(heavy), "digest").select("id", "row", "digest", "group_size", "best")
    return winners.unionByName(rest)


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of `df`: id, digest (SHA-256 of the normalised text), keep_id, group_size, kept."""
    staged = written(
        df.select(F.col(doc_id).alias("id"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    return decided(staged, counters).select(
        "id",
        "digest",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of `df` that stay, all columns. They stay where they lie: the numbers of rows that go are sent to them."""
    rows = numbered(df)
    ids, digests = F.col(f"carried.`{doc_id}`").alias("id"), digest(f"carried.`{text}`").alias("digest")
    found = decided(written(rows.select(ids, digests, "row"), "digests"), counters)
    gone = written(found.where(F.col("row") != F.col("best.row")).select("row"), "copies")
    return without(rows, gone).select("carried.*")
