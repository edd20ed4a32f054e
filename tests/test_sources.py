import json

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.sources import sinks, storage, tables


def test_log_round_trip(spark, tmp_path):
    events = [{"sid": "s", "uid": 1, "bid": 2, "action": "click", "timestamp": 5}, {"sid": None, "uid": 1, "bid": 0, "action": "x", "timestamp": 6}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, events)))
    log = tables.read_log(spark, str(tmp_path))
    assert log.schema == schemas.UI_HISTORY
    assert [r.asDict() for r in log.orderBy("timestamp").collect()] == events
    messages = sinks.event_messages(log).collect()
    assert [(m["key"], json.loads(m["value"])) for m in messages] == [(e["sid"], e) for e in events]


def test_sidecars(spark, tmp_path):
    def write(name, body):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "metadata.opf").write_text(body)

    head = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'
    write("Ann B+/It's 1", head + "<dc:description>&lt;p&gt;One\n two&lt;/p&gt;</dc:description></metadata></package>")
    write("b", head)
    write("c", head + "</metadata></package>")
    found = {r["path"]: (r["description"], r["summary"]) for r in tables.read_sidecars(spark, str(tmp_path)).collect()}
    assert found["Ann B+/It's 1/metadata.opf"][1] == "One two"
    assert found["b/metadata.opf"] == ("NaN", "NaN") and found["c/metadata.opf"] == (None, "NaN")


def test_triplet_csv(spark, tmp_path):
    rows = [([1.0, 0.5], [0.25, -1.0], [0.0, 2.0]), ([1.0, 0.5], None, [0.0, 2.0])]
    triplets = spark.createDataFrame(rows, schemas.TRIPLETS)
    sinks.write_triplets_csv(triplets, str(tmp_path / "t"))
    back = tables.read_triplets_csv(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, triplets.collect()))


def test_prompt_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    contexts = spark.createDataFrame([('[{"id": 1}]', "why, and how?")], "context string, query string")
    sinks.append_prompt_log(contexts, path)
    sinks.append_prompt_log(contexts, path)
    found = spark.read.schema("context string, query string").option("escape", '"').csv(path).collect()
    assert [tuple(r) for r in found] == [('[{"id": 1}]', "why, and how?")] * 2


def test_facts_are_laid_out_by_month(spark, tmp_path):
    facts = spark.createDataFrame([("s", 1, 2, 3, 1704110400), ("s", 1, 2, 3, 1706788800)], "sessionid string, userid int, bookid int, timeid int, at long")
    facts = facts.withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    sinks.append_facts(facts, str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(r["month"] for r in stored.select("month").distinct().collect()) == ["2024-01", "2024-02"]


def test_versions_do_not_touch_the_one_being_read(spark, tmp_path):
    root = str(tmp_path / "t")
    first = sinks.write_version(spark.range(3), root, 0)
    second = sinks.write_version(spark.read.parquet(first).where("id > 0"), root, 1)
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 2
    current, version = sinks.current_version(spark, root)
    assert version == 1 and current.count() == 2


def test_written_is_stored_in_the_shared_folder(spark):
    df = storage.written(spark.range(5).withColumn("x", F.col("id") * 2), "probe")
    assert df.count() == 5 and df.columns == ["id", "x"]
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert base.removeprefix("file:") in df.inputFiles()[0]


def test_tables_are_created_once(spark):
    schemas.create_tables(spark, ["model", "dim_action"])
    schemas.create_tables(spark, ["model"])
    assert spark.table("model").columns == [f.name for f in schemas.MODEL.fields]
    spark.sql("DROP TABLE model")
    spark.sql("DROP TABLE dim_action")


def test_jdbc_needs_a_driver(spark):
    with pytest.raises(Exception, match="(?i)driver"):
        tables.read_jdbc(spark, "jdbc:none:x", "books", "id", (0, 10))


def test_a_file_for_each_key_is_what_the_text_writer_makes_of_it(spark, tmp_path):
    rows = [(n, f"<t>é{n}\n{n}</t>") for n in range(40)] + [(7, "again"), (7, None), (None, "no key"), (-3, ""), (2**40, "far")]
    texts = spark.createDataFrame(rows, "doc long, text string")
    texts.repartition("doc").write.partitionBy("doc").text(f"{tmp_path}/spark")
    for folder in (f"{tmp_path}/own", f"file://{tmp_path}/named"):
        sinks.write_texts(texts, folder, "doc")
        sinks.write_texts(texts, folder, "doc")  # done again, as by a task that is tried twice

    def lines(name):
        found = list((tmp_path / name).glob("*/*.txt"))
        assert len(found) == 43
        return {file.parent.name: sorted(file.read_bytes().split(b"\n")) for file in found}

    assert lines("spark") == lines("own") == lines("named")
    assert not list((tmp_path / "own").glob("*/*.crc"))
