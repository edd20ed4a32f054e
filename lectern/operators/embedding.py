"""Text vectors from a pluggable encoder, called once per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.schemas import VECTOR

Encoder = Callable[[Column], Column]

SLICE_TEXTS = 256  # texts whose words are added up, and whose vectors are handed on, at once; bounds what a worker allocates


def batch_encoder(encode: Callable[[list[str]], np.ndarray], batch: int = 64) -> Encoder:
    """An encoder from a function that turns a list of texts into one row of numbers each.

    The function is called with at most `batch` texts; vectors are scaled to length 1.
    """

    @F.pandas_udf(VECTOR)
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            values = series.fillna("").tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(values), batch):
                part = values[start : start + batch]
                encoded = np.asarray(encode(part), dtype=np.float64)
                if len(encoded) != len(part):
                    raise ValueError("the encoder has to return one vector per text")
                rows.extend(unit_rows(encoded).astype(np.float32))
            yield pd.Series(rows, dtype=object)

    return vectors


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def added_up(hashes: Iterator[pa.Array], dim: int) -> Iterator[pa.Array]:
    """The vectors of lists of word hashes, in order, SLICE_TEXTS at a time whatever comes in a batch."""
    for batch in hashes:
        for start in range(0, len(batch), SLICE_TEXTS):
            some = batch.slice(start, SLICE_TEXTS)
            sizes = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
            flat = some.flatten().to_numpy(zero_copy_only=False)
            slots = np.repeat(np.arange(len(some)), sizes) * dim + np.mod(flat, dim)
            signs = np.where((flat >> 32) & 1, -1.0, 1.0)
            counts = np.bincount(slots, weights=signs, minlength=len(some) * dim).reshape(len(some), dim)
            values = pa.array(unit_rows(counts).astype(np.float32).reshape(-1))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), values)


def hashing_encoder(dim: int = 768, hashed: Callable[[Column], Column] = F.xxhash64) -> Encoder:
    """Signed feature hashing of words: the default when no model is plugged in.

    Words are split and hashed by Spark; Python only adds up signs per vector slot, some texts at a time. The slot
    is the hash modulo `dim`, the sign its bit 32.
    """

    @F.arrow_udf(VECTOR)
    def add_up(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from added_up(hashes, dim)

    def encoder(text: Column) -> Column:
        return add_up(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda word: hashed(word)))

    return encoder


def embed(df: DataFrame, text_col: str, out: str, encoder: Encoder) -> DataFrame:
    return df.withColumn(out, encoder(F.col(text_col)))
