import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    keys = [rng.choice([1, 1, 1, 2, 3, 4, 5, None, None]) for _ in range(400)]
    left = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int").repartition(5)
    right = spark.createDataFrame([(1, "a"), (3, "c"), (6, "f"), (None, "z")], "k int, name string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_is_a_join(sides, how):
    left, right = sides
    plain = left.join(right, ["k"], how)
    split = skew.hot_join(left, right, ["k"], how, min_rows=30)
    assert split.columns == plain.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_counts_null_as_a_key(sides):
    left, _ = sides
    counts = {row["k"]: row["count"] for row in left.groupBy("k").count().collect()}
    hot = {row["k"] for row in skew.hot_keys(left, ["k"], 40).collect()}
    assert hot == {k for k, n in counts.items() if n > 40} and None in hot
    assert skew.hot_keys(left, ["k"], 1000) is None


def test_hot_key_is_found_in_a_sample(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE_ROWS", 2_000)
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [row["k"] for row in skew.hot_keys(rows, ["k"], 20_000).collect()] == [7]


def test_join_checked_beyond_the_bound(sides):
    left, right = sides
    small = skew.join_checked(left, right, ["k"])
    large = skew.join_checked(left, right, ["k"], max_rows=2)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_dense_positions(spark):
    keys = random.Random(3).sample(range(-500, 5000), 700)
    df = spark.createDataFrame([(k,) for k in keys], "idx int").repartition(6)
    found = {row["idx"]: row["p"] for row in skew.dense_positions(df, "idx", "p", width=100).collect()}
    assert found == {k: n for n, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("kind", ["long", "string", "date", "double"])
def test_positions_of_any_key(spark, kind):
    numbers = random.Random(4).sample(range(-(2**40), 2**40), 900)
    column = {"long": F.col("n"), "string": F.concat(F.lit("k"), F.col("n")), "date": F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("n", F.lit(1_999_993)).cast("int")), "double": F.col("n") / 7}[kind]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long").select(column.alias("k")).dropDuplicates().repartition(5)
    keys = sorted(r["k"] for r in df.collect() if r["k"] is not None)
    found = skew.dense_positions(df, "k", "p").collect()
    assert sorted((r["p"], r["k"]) for r in found) == list(enumerate(keys))
    assert skew.dense_positions(df.where("false"), "k", "p").count() == 0


def test_a_third_of_the_rows_in_one_range(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).cast("long").alias("k"))
    found = [(r["p"], r["k"]) for r in skew.sorted_positions(df, "k", "p", parts=11).collect()]
    assert sorted(p for p, _ in found) == list(range(3000)) and [k for _, k in sorted(found)] == sorted(k for _, k in found)


def test_suspects_hold_all_matches_and_few_others(spark):
    small = spark.range(0, 3000, 7).selectExpr("id as a", "if(id % 5 = 0, null, id) as b")
    large = spark.range(20_000).selectExpr("id as a", "if(id % 5 = 0, null, id) as b", "id as n").repartition(4)
    left = {r["n"] for r in skew.suspects(large, small, ["a", "b"]).collect()}
    assert left >= set(range(0, 3000, 7)) and len(left) < 4_000
    assert skew.suspects(large, small.where("false"), ["a", "b"]).count() == 0
    assert skew.suspects(large, small, ["a", "b"]).columns == large.columns
