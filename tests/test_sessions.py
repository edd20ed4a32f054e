"""Session operators against plain Python, with long sessions cut into tiny cells."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.operators import sessions

SCHEMA = "sid string, uid int, bid int, action string, timestamp long, event_id long, item int, reward int"
REWARD = {"click": 1, "skip": -1, "read": 2}


def make_history(seed=1, rows=400):
    rng = random.Random(seed)
    out = []
    for event_id in range(rows):
        sid = rng.choice(["hot", "hot", "hot", "hot", "a", "b", "c", "", None])
        at = rng.choice([None, *range(100, 100 + rows // 6)])  # many events share a second
        action = rng.choice(list(REWARD))
        bid = rng.randrange(9)
        out.append((sid, rng.randrange(3), bid, action, at, event_id, bid, REWARD[action]))
    return out


ROWS = make_history()


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def expected():
    """Ordered rows per session."""
    groups = defaultdict(list)
    for row in ROWS:
        groups[row[0]].append(row)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[4] is None, r[4] or 0, r[5]))
    return groups


CELLS = [1, 3, 10, 1_000_000]


@pytest.mark.parametrize("cell_rows", CELLS)
def test_order(history, expected, cell_rows):
    found = sessions.session_order(history, cell_rows=cell_rows).collect()
    assert len(found) == len(ROWS)
    assert {(r["sid"], r["step"]): r["event_id"] for r in found} == {
        (sid, n): row[5] for sid, rows in expected.items() for n, row in enumerate(rows)
    }


def test_long_sessions_are_cut(history):
    cells = sessions.in_cells(history, cell_rows=10).groupBy("_sid", "_cell").count().collect()
    assert sum(row["_sid"] == "hot" for row in cells) > 10
    assert max(row["count"] for row in cells) < 60


def test_a_second_with_many_rows_is_cut(spark):
    """One session without any time stamp: order comes from the tie-break column alone."""
    rows = [("s", 1, n, "click", None, n, n, 1) for n in range(300)]
    history = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cells = sessions.in_cells(history, cell_rows=20).groupBy("_cell").count().collect()
    assert len(cells) == 15 and max(row["count"] for row in cells) == 20
    found = sessions.sliding_state(history, cell_rows=20).collect()
    assert {r["step"]: [e["item"] for e in r["state"]] for r in found} == {
        n: list(range(max(0, n - 5), n)) for n in range(300)
    }


@pytest.mark.parametrize("cell_rows", CELLS)
def test_sliding_state(history, expected, cell_rows):
    found = {
        (r["sid"], r["step"]): [tuple(e) for e in r["state"]]
        for r in sessions.sliding_state(history, cell_rows=cell_rows).collect()
    }
    for sid, rows in expected.items():
        for n in range(len(rows)):
            assert found[sid, n] == [(r[6], r[7]) for r in rows[max(0, n - 5) : n]]


def test_state_sizes(spark):
    rows = [("s", 1, n, "click", 10 + n, n, n, 1) for n in range(8)]
    states = sessions.sliding_state(spark.createDataFrame(rows, SCHEMA)).orderBy("step").collect()
    assert [len(r["state"]) for r in states] == [0, 1, 2, 3, 4, 5, 5, 5]


@pytest.mark.parametrize("cell_rows", CELLS)
def test_last_events(history, expected, cell_rows):
    found = {r["event_id"]: r for r in sessions.last_n(history, cell_rows=cell_rows).collect()}
    for rows in expected.values():
        for n, row in enumerate(rows):
            recent = rows[max(0, n - 4) : n + 1]
            assert [tuple(e) for e in found[row[5]]["last"]] == [(r[1], r[2], r[7]) for r in recent]
            assert found[row[5]]["state_uid"] == recent[0][1]


def test_last_state(history, expected):
    found = {r["sid"]: r for r in sessions.last_state(history).collect()}
    for sid, rows in expected.items():
        assert [tuple(e) for e in found[sid]["last"]] == [(r[1], r[2], r[7]) for r in rows[-5:]]
        assert found[sid]["uid"] == rows[-5:][0][1]


@pytest.mark.parametrize("cell_rows", CELLS)
@pytest.mark.parametrize("gamma", [0.0, 0.2, 0.9, 0.99])
def test_discounted_return(history, expected, cell_rows, gamma):
    found = {
        (r["sid"], r["step"]): r["ret"]
        for r in sessions.discounted_return(history, gamma, cell_rows=cell_rows).collect()
    }
    for sid, rows in expected.items():
        running = 0.0
        for n in reversed(range(len(rows))):
            running = rows[n][7] + gamma * running
            assert found[sid, n] == pytest.approx(running, abs=1e-9)


def test_discounted_return_example(spark):
    rows = [("s", 1, n, "x", n, n, n, r) for n, r in enumerate([1, -1, 2])]
    found = sessions.discounted_return(spark.createDataFrame(rows, SCHEMA)).orderBy("step").collect()
    assert [r["ret"] for r in found] == pytest.approx([1.9702, 0.98, 2.0])


def test_return_of_a_session_longer_than_a_block(spark):
    """20,000 steps: gamma^n underflows many times over, blocks must not."""
    steps = spark.range(20_000).select(
        F.lit("s").alias("sid"), F.col("id").alias("timestamp"), F.col("id").alias("event_id"),
        (F.col("id") % 4 - 1).cast("int").alias("reward"),
    )
    found = {r["step"]: r["ret"] for r in sessions.discounted_return(steps, 0.5).collect()}
    running = 0.0
    for n in reversed(range(20_000)):
        running = n % 4 - 1 + 0.5 * running
        assert found[n] == pytest.approx(running, abs=1e-9)


def test_gamma_has_bounds(history):
    with pytest.raises(ValueError):
        sessions.discounted_return(history, 1.0)


@pytest.mark.parametrize("cell_rows", [3, 1_000_000])
def test_sequence_parts(history, expected, cell_rows):
    parts = sessions.session_sequence(history, part_rows=4, cell_rows=cell_rows).collect()
    assert max(len(p["sequence"]) for p in parts) <= 4
    joined = defaultdict(list)
    for part in sorted(parts, key=lambda p: p["first_step"]):
        assert part["first_step"] == len(joined[part["sid"]])
        joined[part["sid"]] += [tuple(e) for e in part["sequence"]]
    assert joined == {sid: [(r[6], r[7]) for r in rows] for sid, rows in expected.items()}


def test_training_steps_drop_unknown_books(spark, history, expected):
    books = spark.createDataFrame([(3, 10), (7, 11), (20, 4)], "idx int, id int").union(
        spark.createDataFrame([(100 + n, n) for n in range(4)], "idx int, id int")
    )
    items = {row["id"]: row["item"] for row in sessions.item_index(books).collect()}
    assert [items[i] for i in (10, 11, 4, 0, 1, 2, 3)] == [0, 1, 2, 3, 4, 5, 6]
    found = sessions.training_steps(history.drop("item", "reward"), books, cell_rows=5).collect()
    kept = {sid: [r for r in rows if r[2] in items] for sid, rows in expected.items()}
    assert len(found) == sum(map(len, kept.values()))
    for row in found:
        rows, n = kept[row["sid"]], row["step"]
        assert (row["bid"], row["item"], row["reward"]) == (rows[n][2], items[rows[n][2]], rows[n][7])
        assert [tuple(e) for e in row["state"]] == [(items[r[2]], r[7]) for r in rows[max(0, n - 5) : n]]


def test_valid_events(spark):
    rows = [
        ("s", 1, 1, "click"), ("s", 0, 1, "click"), ("s", 1, 0, "click"), ("", 1, 1, "click"), ("s", 1, 1, ""),
        (None, 1, 1, "click"), ("s", None, 1, "click"), ("s", 1, None, "click"), ("s", 1, 1, None),
    ]
    events = spark.createDataFrame(rows, "sid string, uid int, bid int, action string")
    assert [tuple(r) for r in sessions.valid_events(events).collect()] == [rows[0]]


def test_reward_strict(spark):
    events = spark.createDataFrame([("click",), ("signup",), (None,)], "action string")
    rated, rejects = sessions.reward_strict(events)
    assert [r["reward"] for r in rated.collect()] == [1]
    assert [r["action"] for r in rejects.collect()] == ["signup", None]
