"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


BOOKS = _struct(
    ("idx", T.IntegerType(), False),
    ("id", T.IntegerType(), False),
    ("title", T.StringType(), False),
    ("summary", T.StringType(), False),
    ("image", T.StringType(), False),
    ("pdf_file", T.StringType(), False),
    ("author", T.StringType(), False),
    ("published_date", T.TimestampType(), False),
    ("created_date", T.TimestampType(), False),
    ("modified_date", T.TimestampType(), False),
    ("title_embed", VECTOR, True),
    ("summary_embed", VECTOR, True),
    ("active", T.BooleanType(), True),
)

TAGS = _struct(
    ("id", T.IntegerType(), False),
    ("name", T.StringType(), False),
    ("tag_embed", VECTOR, True),
)

BOOKS_TAGS = _struct(("book_id", T.IntegerType(), False), ("tag_id", T.IntegerType(), False))

EVENT = _struct(
    ("sid", T.StringType(), True),
    ("uid", T.IntegerType(), True),
    ("bid", T.IntegerType(), True),
    ("action", T.StringType(), True),
    ("timestamp", T.LongType(), True),
)

UI_HISTORY = EVENT

REC_HISTORY = _struct(
    ("sid", T.StringType(), True),
    ("uid", T.IntegerType(), True),
    ("bid", T.IntegerType(), True),
    ("timestamp", T.LongType(), True),
)

MODEL = _struct(
    ("id", T.LongType(), False),
    ("type", T.StringType(), False),
    ("weights", T.StringType(), False),
    ("timestamp", T.TimestampType(), True),
)

TRIPLETS = _struct(("anchor", VECTOR, True), ("pos", VECTOR, True), ("neg", VECTOR, True))

DIM_TIME = _struct(
    ("timeid", T.IntegerType(), False),
    ("date", T.DateType(), False),
    ("day", T.IntegerType(), False),
    ("month", T.IntegerType(), False),
    ("year", T.IntegerType(), False),
    ("quarter", T.IntegerType(), False),
    ("day_name", T.StringType(), False),
    ("week_of_year", T.IntegerType(), False),
    ("is_weekend", T.BooleanType(), False),
)

DIM_ACTION = _struct(
    ("actionid", T.IntegerType(), False),
    ("actionname", T.StringType(), False),
    ("description", T.StringType(), True),
)

FACT_RECOMMENDATION = _struct(
    ("sessionid", T.StringType(), False),
    ("userid", T.IntegerType(), False),
    ("bookid", T.IntegerType(), False),
    ("timeid", T.IntegerType(), False),
    ("created_at", T.TimestampType(), True),
)

FACT_USER_INTERACTION = _struct(
    ("sessionid", T.StringType(), False),
    ("userid", T.IntegerType(), False),
    ("bookid", T.IntegerType(), False),
    ("actionid", T.IntegerType(), False),
    ("timeid", T.IntegerType(), False),
    ("created_at", T.TimestampType(), True),
)

TABLES = {
    "books": BOOKS,
    "tags": TAGS,
    "books_tags": BOOKS_TAGS,
    "ui_history": UI_HISTORY,
    "rec_history": REC_HISTORY,
    "model": MODEL,
    "triplet_data": TRIPLETS,
    "dim_time": DIM_TIME,
    "dim_action": DIM_ACTION,
    "fact_recommendation": FACT_RECOMMENDATION,
    "fact_user_interaction": FACT_USER_INTERACTION,
}

# Facts are laid out by month, so a dated query prunes directories instead of using an index.
PARTITIONED_BY = {"fact_recommendation": "month", "fact_user_interaction": "month"}


def create_tables(spark: SparkSession, names: list[str] | None = None, database: str | None = None) -> None:
    """Create the named tables (all by default) where they are absent, in the current database or the named one."""
    before = f"{database}." if database else ""
    for name in names or list(TABLES):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name].fields)
        month = PARTITIONED_BY.get(name)
        layout = f", {month} string) USING parquet PARTITIONED BY ({month})" if month else ") USING parquet"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {before}{name} ({columns}{layout}")
