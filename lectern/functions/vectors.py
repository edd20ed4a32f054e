"""Column expressions over array<float> vectors, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_WEIGHT = 0.5
SUMMARY_WEIGHT = 0.75


def _total(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL when a vector is NULL, NaN when one has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (
        F.when(lengths.isNull(), F.lit(None).cast("double"))
        .when(lengths == 0, F.lit(float("nan")))
        .otherwise(F.lit(1.0) - F.try_divide(dot(a, b), lengths))
    )


def combined(title_distance: Column, summary_distance: Column) -> Column:
    return F.lit(TITLE_WEIGHT) * title_distance + F.lit(SUMMARY_WEIGHT) * summary_distance


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def to_json_vector(c: Column) -> Column:
    return F.to_json(c)
