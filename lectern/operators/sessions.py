"""Session sequences: order, sliding states, discounted returns, last events.

A session is one ordered group, and one session may hold a large share of all rows. Sessions above `cell_rows` rows
are cut, in order, into cells that separate tasks work on. What a cell needs from its neighbours (the last few
events before it, the return that follows it) is computed from one small row per cell and handed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.actions import known_reward, reward
from lectern.operators.skew import dense_positions, hot_keys, join_checked, split_hot
from lectern.sources.storage import written

CELL_ROWS = 5_000_000  # below this a session is sorted by one task in well under a minute
NO_SESSION = "\u0000"  # stands for the NULL session while rows are grouped
LAST = 2**63 - 1       # stands for a missing time, which sorts last
TIE_BREAK = ("event_id",)
GROUP = ["_sid", "_cell"]


# --- events -----------------------------------------------------------------------------------------------


def valid_events(events: DataFrame) -> DataFrame:
    """Events with a book, an action, a user and a session; 0 and the empty string count as absent."""
    return events.where(
        F.col("bid").isNotNull() & (F.col("bid") != 0)
        & F.col("uid").isNotNull() & (F.col("uid") != 0)
        & F.col("action").isNotNull() & (F.col("action") != "")
        & F.col("sid").isNotNull() & (F.col("sid") != "")
    )


def reward_strict(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the reward of their action, and the events whose action has none."""
    rated = events.withColumn("reward", known_reward(F.col("action")))
    return rated.where(F.col("reward").isNotNull()), rated.where(F.col("reward").isNull()).drop("reward")


def item_index(books: DataFrame) -> DataFrame:
    """Dense 0-based position of each book in the order of its serial, gaps closed: (id, idx, item)."""
    return dense_positions(books.select("id", "idx"), "idx", "item")


def history_items(history: DataFrame, books: DataFrame) -> DataFrame:
    """Interactions with known books, with the position of the book and the reward of the action."""
    items = item_index(books).select(F.col("id").alias("bid"), "item")
    joined = join_checked(history, items, ["bid"], sized_by=books)
    return joined.withColumn("reward", reward(F.col("action")))


# --- order ------------------------------------------------------------------------------------------------


def in_cells(
    history: DataFrame, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Rows with `_cell` and `_start`, the number of session rows before the cell.

    Ordinary sessions are one cell numbered -1. In a long session a cell is a run of whole seconds that
    starts in the same stretch of `cell_rows` rows; a second with more rows than that is cut by its first tie-break
    column, when that is an integer.
    """
    keyed = history.withColumn("_sid", F.coalesce("sid", F.lit(NO_SESSION))).withColumn(
        "_at", F.coalesce("timestamp", F.lit(LAST))
    )
    hot = hot_keys(keyed, ["_sid"], cell_rows)
    if hot is None:
        return _one_cell(keyed)
    busy, quiet = split_hot(keyed, hot, ["_sid"])
    busy = _cut_seconds(busy, tie, cell_rows)
    earlier = Window.partitionBy("_sid").orderBy("_at", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        busy.groupBy("_sid", "_at", "_cut")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_cell", F.floor(F.col("_before") / F.lit(cell_rows)).cast("long"))
        .withColumn("_start", F.min("_before").over(Window.partitionBy("_sid", "_cell")))
        .select("_sid", "_at", "_cut", "_cell", "_start")
    )
    celled = join_checked(busy, written(runs, "runs"), ["_sid", "_at", "_cut"]).drop("_cut")
    return _one_cell(quiet).unionByName(celled)


def _cut_seconds(busy: DataFrame, tie: tuple[str, ...], cell_rows: int) -> DataFrame:
    """Rows with `_cut`, which rises with the order inside a second that is too long for one cell."""
    whole = F.lit(0).cast("long")
    sortable = bool(tie) and isinstance(busy.schema[tie[0]].dataType, T.IntegralType)
    crowded = hot_keys(busy, ["_sid", "_at"], cell_rows) if sortable else None
    if crowded is None:
        return busy.withColumn("_cut", whole)
    long_seconds, others = split_hot(busy, crowded, ["_sid", "_at"])
    cut = F.coalesce(F.floor(F.col(tie[0]) / F.lit(cell_rows)).cast("long"), F.lit(LAST))
    return others.withColumn("_cut", whole).unionByName(long_seconds.withColumn("_cut", cut))


def _one_cell(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("_cell", F.lit(-1).cast("long")).withColumn("_start", F.lit(0).cast("long"))


def _order(tie: tuple[str, ...]) -> list[Column]:
    return [F.asc("_at"), *[F.asc_nulls_last(c) for c in tie]]


def session_steps(
    history: DataFrame, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Rows with their 0-based `step` in the session, by time and then by the tie-break columns."""
    inside = Window.partitionBy(*GROUP).orderBy(*_order(tie))
    return in_cells(history, tie, cell_rows).withColumn("_row", F.row_number().over(inside) - 1).withColumn(
        "step", F.col("_start") + F.col("_row")
    )


def _tidy(steps: DataFrame) -> DataFrame:
    return steps.drop("_sid", "_at", "_cell", "_start", "_row")


def session_order(history: DataFrame, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS) -> DataFrame:
    return _tidy(session_steps(history, tie, cell_rows))


def session_sequence(
    items: DataFrame, tie: tuple[str, ...] = TIE_BREAK, part_rows: int = 10_000, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Ordered (item, reward) lists: (sid, first_step, sequence).

    A list ends after `part_rows` events and the session goes on in the next row, so no row grows with a session.
    """
    steps = session_steps(items, tie, cell_rows).withColumn("_part", F.floor(F.col("_row") / F.lit(part_rows)))
    return (
        steps.groupBy(*GROUP, "_part")
        .agg(
            F.first("sid").alias("sid"),
            F.min("step").alias("first_step"),
            F.array_sort(F.collect_list(F.struct("step", "item", "reward"))).alias("_steps"),
        )
        .select("sid", "first_step", F.transform("_steps", lambda s: F.struct(s["item"], s["reward"])).alias("sequence"))
    )


# --- states -----------------------------------------------------------------------------------------------


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - F.lit(n - 1), F.lit(1)), n)


def _before_cell(steps: DataFrame, tie: tuple[str, ...], entry: Column, n: int) -> DataFrame:
    """For each cell of a long session, the `n` entries that precede it."""
    latest = Window.partitionBy(*GROUP).orderBy(*[F.desc("_row")])
    ends = (
        steps.where(F.col("_cell") >= 0)
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= n)
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_row"), entry.alias("entry")))).alias("_ends"))
    )
    cells = Window.partitionBy("_sid").orderBy("_cell").rowsBetween(-n, -1)
    earlier = F.flatten(F.collect_list(F.transform("_ends", lambda e: e["entry"])).over(cells))
    return ends.withColumn("_carried", _last(earlier, n)).select(*GROUP, "_carried")


def _preceding(steps: DataFrame, tie: tuple[str, ...], entry: Column, n: int) -> DataFrame:
    """`steps` with `_seen`, the up to `n` entries before each row of its session."""
    inside = Window.partitionBy(*GROUP).orderBy(*_order(tie)).rowsBetween(-n, -1)
    seen = steps.withColumn("_seen", F.collect_list(entry).over(inside))
    carried = seen.join(_before_cell(steps, tie, entry, n), GROUP, "left")
    return carried.withColumn(
        "_seen", F.when(F.col("_carried").isNull(), F.col("_seen")).otherwise(_last(F.concat("_carried", "_seen"), n))
    ).drop("_carried")


def sliding_state(
    items: DataFrame, window: int = 5, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """For each step the up to `window` earlier (item, reward) entries of the session, oldest first."""
    steps = session_steps(items, tie, cell_rows)
    return _tidy(_preceding(steps, tie, F.struct("item", "reward"), window).withColumnRenamed("_seen", "state"))


def _since_silence(entries: Column, silence: int) -> Column:
    """The entries after the last gap of more than `silence` seconds between two that follow each other."""
    places = F.when(F.size(entries) > 1, F.sequence(F.lit(2), F.size(entries))).otherwise(F.array().cast("array<int>"))
    gap = F.filter(places, lambda i: F.get(entries, i - 1)["timestamp"] - F.get(entries, i - 2)["timestamp"] > silence)
    start = F.coalesce(F.array_max(gap), F.lit(1))
    return F.slice(entries, start, F.greatest(F.size(entries) - start + 1, F.lit(0)))


def _without_time(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["uid"], e["bid"], e["reward"]))


def last_n(
    events: DataFrame, n: int = 5, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS, silence: int | None = None
) -> DataFrame:
    """For each event the last `n` events of its session, itself included, and the user of the oldest of them.

    A session that was silent for more than `silence` seconds of event time starts anew.
    """
    steps = session_steps(events, tie, cell_rows)
    entry = F.struct("uid", "bid", "reward", "timestamp")
    recent = _preceding(steps, tie, entry, n - 1).withColumn("last", F.concat("_seen", F.array(entry)))
    if silence is not None:
        recent = recent.withColumn("last", _since_silence(F.col("last"), silence))
    recent = recent.withColumn("last", _without_time(F.col("last")))
    return _tidy(recent.withColumn("state_uid", F.get("last", F.lit(0))["uid"]).drop("_seen"))


def last_state(
    events: DataFrame, n: int = 5, tie: tuple[str, ...] = TIE_BREAK, silence: int | None = None
) -> DataFrame:
    """The last `n` events of each session, oldest first: (sid, uid of the oldest, last); those since the last silence only,
    as in `last_n`.

    The rank limit is applied before rows move, so a long session sends `n` rows per task.
    """
    latest = Window.partitionBy("sid").orderBy(F.desc_nulls_first("timestamp"), *[F.desc_nulls_first(c) for c in tie])
    recent = events.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= n)
    entry = F.struct((-F.col("_back")).alias("_at"), "uid", "bid", "reward", "timestamp")
    listed = recent.groupBy("sid").agg(F.array_sort(F.collect_list(entry)).alias("_last"))
    if silence is not None:
        listed = listed.withColumn("_last", _since_silence(F.col("_last"), silence))
    return listed.select(
        "sid", F.get("_last", F.lit(0))["uid"].alias("uid"), _without_time(F.col("_last")).alias("last")
    )


# --- returns ----------------------------------------------------------------------------------------------


def _with_returns(steps: DataFrame, gamma: float, cell_rows: int) -> DataFrame:
    """`steps` with `ret`, G_t = r_t + gamma * G_{t+1} over the rest of the session.

    Rewards are summed backwards in blocks of B rows with weights gamma^k, k counted inside the block. B is the
    distance at which gamma^B < 1e-20, so weights never underflow and only the start of the next block counts.
    """
    if not 0 <= gamma < 1:
        raise ValueError("gamma must be at least 0 and below 1")
    if gamma == 0:
        return steps.withColumn("ret", F.col("reward").cast("double"))
    block_rows = math.ceil(math.log(1e-20) / math.log(gamma))
    rate = F.lit(float(gamma))
    place = F.col("_row") % F.lit(block_rows)
    blocks = steps.withColumn("_block", F.floor(F.col("_row") / F.lit(block_rows)))
    backwards = Window.partitionBy(*GROUP, "_block").orderBy(F.desc("_row")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    own = F.sum(F.col("reward") * F.pow(rate, place)).over(backwards) / F.pow(rate, place)
    following = Window.partitionBy(*GROUP).orderBy("_block").rangeBetween(1, 1)
    next_block = F.coalesce(F.sum(F.when(place == 0, F.col("_own"))).over(following), F.lit(0.0))
    inside = (
        blocks.withColumn("_own", own)
        .withColumn("_next", next_block)
        .withColumn("ret", F.col("_own") + F.pow(rate, F.lit(block_rows) - place) * F.col("_next"))
        .drop("_block", "_own", "_next")
    )
    reach = math.ceil(block_rows / cell_rows) + 1  # cells that can start within B rows
    cells = (
        inside.where(F.col("_cell") >= 0)
        .groupBy(*GROUP)
        .agg(
            F.first("_start").alias("_from"),
            F.count(F.lit(1)).alias("_size"),
            F.max(F.when(F.col("_row") == 0, F.col("ret"))).alias("_ret"),
        )
        .withColumn(
            "_after",
            F.collect_list(F.struct("_from", "_ret")).over(
                Window.partitionBy("_sid").orderBy("_cell").rowsBetween(1, reach)
            ),
        )
    )
    follow = F.aggregate(
        "_after",
        F.lit(0.0).cast("double"),
        lambda acc, c: acc + c["_ret"] * F.pow(rate, c["_from"] - F.col("_from") - F.col("_size")),
    )
    handed = cells.select(*GROUP, "_size", follow.alias("_follow"))
    rest = F.pow(rate, F.col("_size") - F.col("_row")) * F.col("_follow")
    return inside.join(handed, GROUP, "left").withColumn("ret", F.col("ret") + F.coalesce(rest, F.lit(0.0))).drop(
        "_size", "_follow"
    )


def discounted_return(
    items: DataFrame, gamma: float = 0.99, tie: tuple[str, ...] = TIE_BREAK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    return _tidy(_with_returns(session_steps(items, tie, cell_rows), gamma, cell_rows))


def training_steps(
    history: DataFrame,
    books: DataFrame,
    window: int = 5,
    gamma: float = 0.99,
    tie: tuple[str, ...] = TIE_BREAK,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per session step: item chosen, reward, the state before it and the return from it on."""
    steps = session_steps(history_items(history, books), tie, cell_rows)
    seen = _preceding(steps, tie, F.struct("item", "reward"), window).withColumnRenamed("_seen", "state")
    returns = _with_returns(seen, gamma, cell_rows)
    return returns.select("sid", "step", "bid", "item", "reward", "state", "ret")
