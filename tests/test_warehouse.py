import datetime as dt

import pytest

from lectern import schemas
from lectern.operators import warehouse

UI = "sid string, uid int, bid int, action string, timestamp long"
NOON = 1704110400  # 2024-01-01 12:00 UTC


@pytest.fixture(scope="module")
def dims(spark):
    return warehouse.dim_time(spark), warehouse.dim_action(spark)


def load(spark, dims, rows, facts=None):
    return warehouse.load_facts(spark.createDataFrame(rows, UI), facts, *dims)


def test_dim_time(dims):
    days = {row["date"]: row for row in dims[0].collect()}
    assert len(days) == 1096 and min(r["timeid"] for r in days.values()) == 1
    day = days[dt.date(2024, 12, 30)]
    assert (day["week_of_year"], day["day_name"], day["quarter"], day["is_weekend"]) == (1, "Monday   ", 4, False)
    assert days[dt.date(2024, 12, 29)]["is_weekend"] and days[dt.date(2024, 12, 28)]["is_weekend"]


def test_copies_in_one_load_are_kept_and_later_ones_are_not(spark, dims):
    first, rejects = load(spark, dims, [("s", 1, 2, "click", NOON)] * 2)
    assert first.count() == 2 and rejects.count() == 0
    again, rejects = load(spark, dims, [("s", 1, 2, "read", NOON)], first)
    assert again.count() == 0 and rejects.count() == 0


def test_rejects(spark, dims):
    late = int(dt.datetime(2027, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    rows = [("s", 1, 2, "click", late), ("s", 1, 2, "signup", NOON), ("s", None, 2, "click", NOON)]
    facts, rejects = load(spark, dims, rows)
    assert facts.count() == 0 and rejects.count() == 3
    # A missing key never matches, so such a row is rejected again; an unknown action with a known key is not seen.
    known, _ = load(spark, dims, [("s", 1, 2, "click", NOON)])
    _, rejects = load(spark, dims, rows, known)
    assert sorted(r["userid"] or 0 for r in rejects.collect()) == [0, 1]


def test_outcome_counts_pairs(spark, dims):
    ui, _ = load(
        spark, dims,
        [("s", 1, 2, "click", NOON), ("s", 1, 2, "click", NOON + 1), ("t", 1, 2, "read", NOON + 2), ("s", 9, 9, "skip", NOON)],
    )
    recs = spark.createDataFrame(
        [("s", 1, 2, NOON), ("s", 1, 2, NOON + 5), ("s", 1, 3, NOON), ("s", 1, 2, NOON + 86400)],
        "sid string, uid int, bid int, timestamp long",
    )
    rec, _ = warehouse.load_facts(recs, spark.createDataFrame([], schemas.FACT_RECOMMENDATION), dims[0])
    found = warehouse.rec_outcome_by_action(rec, ui, *dims, ordered=True).collect()
    day, after = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert [tuple(r) for r in found] == [
        (day, "click", 0, 4, 0, 0, 1, 4),
        (day, "read", 0, 0, 2, 0, 1, 2),
        (day, None, 0, 0, 0, 1, 1, 1),
        (after, None, 0, 0, 0, 1, 1, 1),
    ]
    assert warehouse.chart_rec_by_action(warehouse.rec_outcome_by_action(rec, ui, *dims)).count() == 2


def test_monthly_analysis(spark, dims):
    ui, _ = load(spark, dims, [("s", 1, 2, "click", NOON), ("s", 2, 2, "click", NOON), ("s", 2, 3, "click", NOON + 9)])
    found = warehouse.interaction_analysis(ui, *dims)
    assert [tuple(r) for r in found.collect()] == [(2024, 1, 1, "click", 3, 2, 2)]
    assert [tuple(r) for r in warehouse.actions_per_user_month(found).collect()] == [("2024-01", "click", 1.5)]
