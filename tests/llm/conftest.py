import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import AWKWARD  # noqa: E402

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *[T.StructField(name, T.StringType()) for name in ("id", "digest", "vertex", "row", "size", "key", "carried", "range", "toxic")],
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""

    def made(rows):
        full = [(*row, None, None)[:4] for row in rows]
        return spark.createDataFrame([(*row, len(row[1] or ""), *["x"] * 9) for row in full], DOCUMENTS).repartition(3)

    return made


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD)
