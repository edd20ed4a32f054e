"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources that list them. Words flow from source quotas
through patterns; the k-th repetition of a pattern's words costs 2k - 1, so costs are convex and a repetition is used
only where no fresh words are left. The driver solves the flow over one row per pattern; documents never leave Spark.
Each pattern then takes whole copies of all its documents, and for the rest documents in the order of a seeded hash:
sums over buckets of the hash find the one bucket where the rest ends, only its rows are ordered, and one more
document that fits the last gap best closes it.

Defined results: NULL text has size 0; a document without sources (NULL) belongs to the source NULL; documents of
size 0 take nothing; rows that repeat are documents of their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.data import text_of
from lectern.llm.rows import marked, numbered
from lectern.sources.storage import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
SEED = 17


def targets(sizes: dict[str | None, int], weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = REPEATS):
    """Words wanted of each source: `share` times all words by weight, none above `most` times its own words."""
    names = sorted((name for name in sizes if name is not None)) + ([None] if None in sizes else [])
    cycle = list(weights)
    weight = {name: cycle[i % len(cycle)] for i, name in enumerate(names)}
    found: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[name] for name in open_)
        over = [name for name in open_ if left * weight[name] / total > most * sizes[name]]
        if not over:
            found |= {name: left * weight[name] / total for name in open_}
            break
        for name in over:
            found[name] = float(most * sizes[name])
        left -= sum(found[name] for name in over)
        open_ = [name for name in open_ if name not in over]
    return found


def flow(quotas: list[int], patterns: list[tuple[list[int], int]], repeats: int = REPEATS) -> list[list[int]]:
    """Words each pattern gives to each source, at the least total cost among the largest flows.

    `patterns` are (positions of sources, words). An augmenting path costs what the repetition it ends in costs, so
    the cheapest paths come first when the repetitions are opened one after the other.
    """
    given = [[0] * len(quotas) for _ in patterns]
    left = list(quotas)
    used = [0] * len(patterns)
    of_source: list[list[int]] = [[] for _ in quotas]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            of_source[s].append(p)
    for copies in range(1, repeats + 1):
        room = [copies * words - taken for (_, words), taken in zip(patterns, used)]
        while True:
            came: dict[int, tuple[int, int] | None] = {}  # pattern -> (source, pattern before)
            reached = {s for s, n in enumerate(left) if n > 0}
            queue, root, end = deque(), {}, None
            for s in reached:
                for p in of_source[s]:
                    if p not in came:
                        came[p], root[p] = (s, -1), s
                        queue.append(p)
            seen = set(reached)
            while queue and end is None:
                p = queue.popleft()
                if room[p] > 0:
                    end = p
                    break
                for s, words in enumerate(given[p]):
                    if words > 0 and s not in seen:  # what s takes here, it can take elsewhere
                        seen.add(s)
                        for other in of_source[s]:
                            if other not in came:
                                came[other], root[other] = (s, p), root[p]
                                queue.append(other)
            if end is None:
                break
            steps, p = [], end
            while p != -1:
                s, before = came[p]
                steps.append((s, p, before))
                p = before
            most = min([room[end], left[root[end]], *(given[before][s] for s, _, before in steps if before != -1)])
            for s, p, before in steps:
                given[p][s] += most
                if before != -1:
                    given[before][s] -= most
            room[end] -= most
            used[end] += most
            left[root[end]] -= most
    return given


def planned(staged: DataFrame, weights: Iterable[float], share: float, repeats: int) -> DataFrame:
    """(pattern, whole, rest, source_size, target): what each pattern takes; one row per pattern on the driver."""
    rows = staged.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    sizes: dict[str | None, int] = {}
    for row in rows:
        for name in row["pattern"]:
            sizes[name] = sizes.get(name, 0) + row["words"]
    wanted = targets(sizes, weights, share, repeats)
    names = list(wanted)
    place = {name: i for i, name in enumerate(names)}
    patterns = [([place[name] for name in row["pattern"]], row["words"]) for row in rows]
    given = flow([round(wanted[name]) for name in names], patterns, repeats)
    out = []
    for row, parts in zip(rows, given):
        taken, words = sum(parts), row["words"]
        first = row["pattern"][0]
        whole, rest = divmod(taken, words) if words else (0, 0)
        out.append((row["pattern"], whole, rest, sizes[first], wanted[first]))
    schema = "pattern array<string>, whole long, rest long, source_size long, target double"
    # As an Arrow table: a list of rows would start more Python workers on every executor.
    columns = [list(column) for column in zip(*out)] or [[]] * 5
    kinds = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["pattern", "whole", "rest", "source_size", "target"])
    return staged.sparkSession.createDataFrame(table, schema)


def sized(rows: DataFrame, members: str, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Numbered rows with size, pattern (sorted set of sources), a seeded order `key` and its bucket."""
    of = F.col(f"carried.`{members}`")
    if not isinstance(rows.select(of.alias("of")).schema["of"].dataType, T.ArrayType):
        of = F.array(of)
    body = text_of(f"carried.`{text}`")
    nowhere = F.array(F.lit(None).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.transform(of, lambda m: m.cast("string"))))
    return rows.select(
        "carried",
        "row",
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.when(F.coalesce(F.size(pattern), F.lit(0)) < 1, nowhere).otherwise(pattern).alias("pattern"),
        F.xxhash64(F.lit(seed), F.col(f"carried.`{doc_id}`"), body).alias("key"),
    ).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))


def chosen(staged: DataFrame, plan: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(pattern, before, edge): buckets below the edge are taken as a whole; (row): further rows that are taken."""
    rows = staged.join(F.broadcast(plan.where("rest > 0").select("pattern", "rest")), "pattern")
    sums = rows.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("pattern").orderBy("bucket")
    up_to = F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = written(
        sums.withColumn("up_to", up_to)
        .where("up_to > rest and up_to - words <= rest")
        .select("pattern", F.col("bucket").alias("edge"), (F.col("rest") - F.col("up_to") + F.col("words")).alias("gap")),
        "edges",
    )
    border = rows.join(F.broadcast(edges), "pattern").where("bucket = edge")
    running = Window.partitionBy("pattern").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = written(border.withColumn("running", F.sum("size").over(running)).select("pattern", "row", "size", "gap", "running"), "border")
    inside = border.where("running <= gap")
    gaps = edges.join(
        inside.groupBy("pattern").agg(F.max("running").alias("filled")), "pattern", "left"
    ).select("pattern", "edge", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap"))
    free = rows.join(F.broadcast(gaps), "pattern").where("bucket >= edge and size > 0 and abs(size - gap) < gap")
    free = free.join(inside.select("row"), "row", "left_anti")
    last = free.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "key", "row")).alias("best"))
    extra = inside.select("row").unionByName(last.select(F.col("best.row").alias("row")))
    return edges, written(extra, "extra")


def mixed(
    df: DataFrame,
    members: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: Iterable[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(carried, size, source_size, target, copies): all columns of `df` packed, the words of the document, the size
    and target of its (first) source, and the times it is taken.

    `members` is a column of one source or of a list of sources.
    """
    rows = sized(numbered(df), members, text, doc_id, seed)
    light = written(rows.drop("carried"), "sized")
    plan = planned(light, weights, share, repeats)
    edges, extra = chosen(light, plan)
    ends = plan.join(edges, "pattern", "left").drop("gap")
    # Everything below is decided where a row lies; `extra` holds rows of one bucket in BUCKETS and one per pattern.
    below = F.when(F.col("rest") == 0, False).otherwise(F.col("bucket") < F.col("edge"))
    named = marked(rows.join(F.broadcast(ends), "pattern"), extra, "extra")
    copies = F.col("whole") + below.cast("int") + F.col("extra").cast("int")
    return named.select(
        "carried", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies")
    )


def mixed_documents(df: DataFrame, members: str = "source", text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns."""
    taken = mixed(df, members, text, doc_id, **options).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("carried.*")
