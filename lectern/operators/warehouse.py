"""Star schema: dimensions, incremental fact load, analytic views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.actions import epoch_date, epoch_ts, month_label
from lectern.operators.skew import hot_join, suspects

FIRST_DAY = dt.date(2024, 1, 1)
LAST_DAY = dt.date(2026, 12, 31)

# The actions of the warehouse with their descriptions.
ACTIONS = [
    ("click", "User clicked the book"),
    ("read", "User read the book"),
    ("skip", "User skipped (not care) the book"),
]

FACT_KEYS = ["sessionid", "userid", "bookid", "created_at"]


def dim_time(spark: SparkSession, first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY) -> DataFrame:
    """One row per day; the day name is blank-padded to nine characters and the week is the ISO week."""
    days = spark.range((last - first).days + 1, numPartitions=1)
    date = F.date_add(F.lit(first), F.col("id").cast("int"))
    return days.select((F.col("id") + 1).cast("int").alias("timeid"), date.alias("date")).select(
        "timeid",
        "date",
        F.dayofmonth("date").alias("day"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.rpad(F.date_format("date", "EEEE"), 9, " ").alias("day_name"),
        F.weekofyear("date").alias("week_of_year"),
        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
    )


def dim_action(spark: SparkSession) -> DataFrame:
    rows = [(number, *action) for number, action in enumerate(ACTIONS, start=1)]
    return spark.createDataFrame(rows, schemas.DIM_ACTION)


def lookup_dims(history: DataFrame, times: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """History rows with their dimension ids, NULL where a dimension has no such day or action.

    Both dimensions are bounded by the calendar and the list of actions, so they are broadcast.
    """
    days = times.select(F.col("date").alias("_day"), "timeid")
    looked = history.withColumn("_day", epoch_date(F.col("timestamp"))).join(F.broadcast(days), "_day", "left")
    columns = [
        F.col("sid").alias("sessionid"),
        F.col("uid").alias("userid"),
        F.col("bid").alias("bookid"),
    ]
    if actions is not None:
        names = actions.select(F.col("actionname").alias("action"), "actionid")
        looked = looked.join(F.broadcast(names), "action", "left")
        columns.append(F.col("actionid"))
    return looked.select(*columns, "timeid", epoch_ts(F.col("timestamp")).alias("created_at"))


def new_facts(staged: DataFrame, facts: DataFrame, keys: list[str] = FACT_KEYS, large: bool = False) -> DataFrame:
    """Staged rows whose key is not among the facts; a NULL in a key never matches.

    The action is not part of the key, and copies inside the staged rows are all kept. Only facts in the span of the
    staged instants are read, so a load costs what it brings and not what is stored. Of `large` facts only those that
    a bitmap of the staged keys lets through are shuffled; `staged` should then be written.
    """
    span = staged.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    near = facts.where(
        (F.col("created_at") >= span.select("first").scalar()) & (F.col("created_at") <= span.select("last").scalar())
    )
    stored = near.select(*keys)
    if large:
        stored = suspects(stored, staged.select(*keys), keys)
    return hot_join(staged, stored.distinct(), keys, "left_anti")


def load_facts(
    history: DataFrame, facts: DataFrame | None, times: DataFrame, actions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New facts and rejects of an incremental load; `facts` is None for the first one.

    A row that lacks a session, user, book, action or day cannot be a fact. The whole load would fail on it in a
    database; here it is handed back as a reject.
    """
    staged = lookup_dims(history, times, actions)
    return split_facts(staged if facts is None else new_facts(staged, facts))


def split_facts(fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Looked-up rows that are complete, and the others."""
    complete = F.lit(True)
    for name in fresh.columns:
        if name != "created_at":
            complete = complete & F.col(name).isNotNull()
    return fresh.where(complete), fresh.where(~complete)


def new_rejects(rejects: DataFrame, stored: DataFrame) -> DataFrame:
    """Rejects without an equal row among the stored ones; NULL equals NULL here, and copies inside a load are kept."""
    known = stored.select(*rejects.columns).distinct()
    same = [rejects[name].eqNullSafe(known[name]) for name in rejects.columns]
    return rejects.join(known, same, "left_anti")


def rec_outcomes(recommendations: DataFrame, interactions: DataFrame) -> DataFrame:
    """Recommendations met by interactions of the same user, book and day, as counted pairs.

    One row per (user, book, day, action) with `pairs` row pairs; `actionid` is NULL for a recommendation nobody
    acted on. Both sides are counted per key before they meet, so a key with many rows moves as one row
    and pairs are multiplied, never listed.
    """
    keys = ["userid", "bookid", "timeid"]
    recommended = recommendations.groupBy(*keys).agg(F.count(F.lit(1)).alias("recommended"))
    acted = interactions.groupBy(*keys, "actionid").agg(F.count(F.lit(1)).alias("acted"))
    return recommended.join(acted, keys, "left").withColumn(
        "pairs", F.col("recommended") * F.coalesce("acted", F.lit(1))
    )


def rec_outcome_by_action(
    recommendations: DataFrame,
    interactions: DataFrame,
    times: DataFrame,
    actions: DataFrame,
    ordered: bool = False,
) -> DataFrame:
    """Daily recommendation outcome per action; the NULL action is the group without interaction."""
    named = rec_outcomes(recommendations, interactions).join(
        F.broadcast(actions.select("actionid", F.col("actionname").alias("action_type"))), "actionid", "left"
    )
    dated = named.join(
        F.broadcast(times.select("timeid", F.col("date").alias("recommendation_date"))), "timeid"
    )

    def pairs_of(action: str):
        return F.sum(F.when(F.col("action_type") == action, F.col("pairs")).otherwise(0))

    outcome = dated.groupBy("recommendation_date", "action_type").agg(
        pairs_of("skip").alias("total_skipped"),
        pairs_of("click").alias("total_clicked"),
        pairs_of("read").alias("total_read"),
        F.sum(F.when(F.col("acted").isNull(), F.col("pairs")).otherwise(0)).alias("total_no_interaction"),
        F.count_distinct("bookid").alias("total_recommended_books"),
        F.sum("pairs").alias("total_recommendations"),
    )
    if ordered:
        outcome = outcome.orderBy("recommendation_date", F.asc_nulls_last("action_type"))
    return outcome


def interaction_analysis(interactions: DataFrame, times: DataFrame, actions: DataFrame) -> DataFrame:
    """Monthly interactions per action: count, distinct users, distinct books."""
    dated = interactions.join(F.broadcast(times.select("timeid", "year", "quarter", "month")), "timeid")
    named = dated.join(F.broadcast(actions.select("actionid", "actionname")), "actionid")
    return named.groupBy("year", "quarter", "month", "actionname").agg(
        F.count(F.lit(1)).alias("action_count"),
        F.count_distinct("userid").alias("unique_users"),
        F.count_distinct("bookid").alias("unique_books"),
    )


def actions_per_user_month(analysis: DataFrame) -> DataFrame:
    return analysis.select(
        month_label(F.col("year"), F.col("month")).alias("month_label"),
        "actionname",
        (F.col("action_count") / F.col("unique_users")).alias("action_per_user"),
    )


def chart_rec_by_action(outcome: DataFrame) -> DataFrame:
    """Distinct recommended books per day and action; days without action are not drawn."""
    return outcome.where(F.col("action_type").isNotNull()).select(
        "recommendation_date", "action_type", "total_recommended_books"
    )
