"""Document fingerprints: every shingle hash below a fixed fraction of all hashes.

A shingle is a run of SHINGLE code points. Since the threshold is the same for all texts, the fingerprint of texts
together is the union of their fingerprints, and the part of a small one that lies in a large one estimates
containment, however unequal the texts are. Where no hash is below the threshold the least one stands alone, so that only
the empty text has an empty fingerprint; a union drops it as soon as another hash is below the threshold. The fingerprint is
written as its sorted 64-bit hashes in base 64, from which `read_back`, `together` and `contained` go on.

For the text that follows in descending order of ids, rows are dealt to ranges of ids; the first row of each range also
goes to the range before it, and each range is passed once in order.

Defined results: NULL text is empty; a text shorter than a shingle is one shingle; equal texts have equal fingerprints; two
empty fingerprints are alike (1), an empty one and another are not (0). Rows without an id come last in
descending order, rows of one id in the order of a hash of the text. After the last row comes the first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrays import mixed, powers, prefix_hashes, slices
from lectern.llm.data import partitions, text_of

SHINGLE = 10
FRACTION = 16                   # one in so many hashes is kept
THRESHOLD = np.uint64((1 << 64) // FRACTION)


def hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `size` code points, in order; of the whole text where it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64)
    size = min(size, len(points))
    sums = prefix_hashes(mixed(points.astype(np.uint64) + np.uint64(1)))
    return mixed((sums[size:] - sums[:-size]) * powers(len(sums))[1][: len(points) - size + 1] + np.uint64(size))


def kept(found: np.ndarray) -> np.ndarray:
    """The hashes a fingerprint keeps, sorted."""
    below = found[found < THRESHOLD]
    if not len(below) and len(found):
        below = found[found == found.min()]
    return np.unique(below)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kept hashes of two texts together."""
    return kept(np.concatenate([a, b]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of all hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of those of the text with fewer."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written_out(found: np.ndarray) -> str:
    return base64.b64encode(np.unique(found).astype("<u8").tobytes()).decode()


def read_back(fingerprint: str | None) -> np.ndarray:
    """The hashes of a written fingerprint, none of a NULL one."""
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u8").astype(np.uint64)


@F.pandas_udf(T.StringType())
def together(fingerprints_: pd.Series) -> str:
    """An aggregate: the fingerprint of the texts of a group together, from their written fingerprints."""
    found = np.empty(0, np.uint64)
    for fingerprint in fingerprints_:
        found = merged(found, read_back(fingerprint))
    return written_out(found)


@F.pandas_udf(T.DoubleType())
def contained(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of the text with fewer hashes lies in the other, from their written fingerprints."""
    return pd.Series([containment(read_back(x), read_back(y)) for x, y in zip(a, b)], dtype=float)


def edited_hashes(own: np.ndarray, text: str, after: np.ndarray, next_text: str, size: int = SHINGLE) -> tuple[str, np.ndarray]:
    """The edited text, and its hashes from those of the two texts: only runs across the seam are new."""
    n, m = len(text), len(text) // 2
    head, tail = text[: n - m], next_text[:m]
    edited = head + tail
    if len(head) < size or len(tail) < size:
        return edited, hashes(edited, size)
    seam = head[1 - size :] + tail[: size - 1]
    return edited, np.concatenate([own[: len(head) - size + 1], hashes(seam, size), after[: len(tail) - size + 1]])


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, contained_edited double, contained_next double"
)


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `df`, see COLUMNS: its fingerprint, that of its edited text, and how alike they are.

    The edited text has, for its last half, as many first code points of the next text in descending order of ids.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ids = rows.select("doc_id")
    ranges = 4 * partitions(spark)
    found = ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = np.unique(np.array(found, np.int64))

    @F.pandas_udf("int")
    def descending(value: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, value.to_numpy(), side="right"), dtype="int32")

    # 0 for the largest ids; rows without an id come after all others.
    place = descending(F.coalesce("doc_id", F.lit(0).cast("long")))
    place = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place)
    dealt = ids.select("doc_id", place.alias("range"))
    firsts = dealt.groupBy("range").agg(F.max("doc_id").alias("first")).orderBy("range").collect()  # a row per range
    filled = [row["range"] for row in firsts]
    before = {at: filled[i - 1] for i, at in enumerate(filled)}  # the range before the first one is the last
    heads = spark.createDataFrame(
        [(row["range"], row["first"], before[row["range"]]) for row in firsts], "at int, first long, before int"
    )
    placed = rows.withColumn("range", place).withColumn("key", F.xxhash64("text"))
    starts = placed.join(F.broadcast(heads), (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("first")))
    guards = starts.select("doc_id", "text", F.col("before").alias("range"), "key", F.lit(True).alias("guard"))
    all_rows = placed.withColumn("guard", F.lit(False)).select("doc_id", "text", "range", "key", "guard").unionByName(guards)
    order = ["range", "guard", F.desc_nulls_last("doc_id"), "key", "text"]
    ordered = all_rows.repartition("range").sortWithinPartitions(*order).select("doc_id", "text", "range", "guard")
    return ordered.mapInArrow(passed, COLUMNS)


def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges in order, each followed by its guards: results for all rows but guards."""
    held = None
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for doc_id, text, place, guard in zip(*(part.column(i).to_pylist() for i in range(4))):
                if held is not None and held[3] == place:
                    if not held[4]:
                        found = hashes(text)
                        out.append(result(held, text, found))
                    elif guard:
                        continue  # rows that repeat the first one of the next range
                else:
                    found = None
                held = (doc_id, text, hashes(text) if found is None else found, place, guard)
                found = None
            if out:
                yield columns_of(out)


def result(row: tuple, next_text: str, after: np.ndarray) -> tuple:
    doc_id, text, own, _, _ = row
    edited, changed = edited_hashes(own, text, after, next_text)
    a, b, c = kept(own), kept(changed), kept(after)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    measures = (likeness(a, b), likeness(a, c), containment(a, b), containment(a, c))
    return (doc_id, len(text), digest, written_out(a), written_out(b), *measures)


def columns_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    names = [part.split()[0] for part in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
