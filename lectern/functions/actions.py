"""Column expressions over actions, rewards and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each action is worth.
REWARDS = {"click": 1, "skip": -1, "read": 2}


def known_reward(action: Column) -> Column:
    """Reward of a known action, NULL for any other."""
    chain = F.lit(None).cast("int")
    for name, worth in REWARDS.items():
        chain = F.when(action == name, F.lit(worth)).otherwise(chain)
    return chain


def reward(action: Column) -> Column:
    """Reward of an action, 0 when it is unknown or missing."""
    return F.coalesce(known_reward(action), F.lit(0))


def reward_index(value: Column) -> Column:
    """Reward category: 1 viewed, 2 read, 0 anything else."""
    return F.when(value == 1, 1).when(value == 2, 2).otherwise(0)


def epoch_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def epoch_date(seconds: Column) -> Column:
    """UTC date of an epoch second, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400)).cast("int"))


def month_label(year: Column, month: Column) -> Column:
    """`YYYY-MM`."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))
