"""What moves or is held where tables are large."""

from pyspark.sql import functions as F

from lectern.operators import catalogue
from lectern.session import small_files_session


def test_wide_rows_are_numbered_by_their_keys_alone(spark):
    rows = spark.createDataFrame([(n * 7 % 50, "x" * 50) for n in range(50)], "id int, text string")
    found = catalogue._numbered(rows, "id", "place")
    assert {r["id"]: r["place"] for r in found.collect()} == {n: n for n in range(50)}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    twice = catalogue._numbered(rows.unionByName(rows.where("id < 3")), "id", "place").collect()
    assert sorted(r["place"] for r in twice) == list(range(53)) and [r["id"] for r in sorted(twice, key=lambda r: r["place"])][:6] == [0, 0, 1, 1, 2, 2]


def test_small_files_share_tasks(spark, tmp_path):
    spark.range(200).withColumn("t", F.lit("x")).repartition(200, "id").select("t").write.text(str(tmp_path / "files"))
    read = small_files_session(spark).read.text(str(tmp_path / "files"), wholetext=True)
    usual = spark.read.text(str(tmp_path / "files"), wholetext=True)
    assert read.rdd.getNumPartitions() <= usual.rdd.getNumPartitions() and read.count() == usual.count()
