"""The jobs one after the other over one lake."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import policy, registry, sessions, warehouse
from lectern.plans import domain, jobs
from lectern.sources import buckets
from lectern.sources.tables import read_sidecars
from lectern.session import streaming_session
from lectern.streaming import interactions as stream


@pytest.fixture(scope="module")
def lake(spark, small, tmp_path_factory):
    base = tmp_path_factory.mktemp("books")
    source = domain.source_catalogue(spark, small)
    for row in source["books"].where("id % 4 = 0").select("path").collect():
        folder = base / row["path"]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "metadata.opf").write_text(
            f"<package xmlns:dc='u'><metadata><dc:description>About {row['path'].replace(chr(39), '')}</dc:description></metadata></package>"
        )
    root = str(tmp_path_factory.mktemp("lake"))
    first = {**source, "books": source["books"].where("id % 7 != 2")}
    second = {**source, "books": source["books"].where("id % 10 != 3"), "books_tags_link": source["books_tags_link"].where("book % 2 = 0")}
    for snapshot in (first, second):
        jobs.catalogue_etl(spark, snapshot, read_sidecars(spark, str(base)), root)
    return root


def test_catalogue(spark, small, lake):
    books = jobs.catalogue_table(spark, lake, "books")
    rows = {r["id"]: r for r in books.collect()}
    assert buckets.listing(spark, f"{lake}/books")[1] == 1 and len(rows) == books.count()
    every = {r["p_partkey"] for r in domain.read_table(spark, small, "part").collect()}
    first, second = {i for i in every if i % 7 != 2}, {i for i in every if i % 10 != 3}
    assert set(rows) == first | second
    assert {i for i, r in rows.items() if not r["active"]} == first - second
    assert sorted(r["idx"] for r in rows.values()) == list(range(1, len(rows) + 1))
    assert [i for i in sorted(rows, key=lambda i: rows[i]["idx"])] == sorted(first) + sorted(second - first)
    assert all((r["summary"] == "NaN") == (i % 4 != 0) for i, r in rows.items())
    assert all(len(r["summary_embed"]) == 768 for r in rows.values())
    pairs = jobs.catalogue_table(spark, lake, "books_tags")
    assert pairs.where("book_id % 2 = 1").count() == 0 and pairs.count() == len([i for i in every if i % 2 == 0])


def test_only_changed_id_ranges_are_written(spark, small, tmp_path):
    source = domain.source_catalogue(spark, small)
    nothing = spark.createDataFrame([], "path string, description string")
    lake = str(tmp_path)
    snapshots = (source, {**source, "books": source["books"].where("id <> 75")}, source, source)
    files = []
    for snapshot in snapshots:
        jobs.catalogue_etl(spark, snapshot, nothing, lake, width=20)
        found = {name: jobs.catalogue_table(spark, lake, name).inputFiles() for name in jobs.KEYS}
        files.append({name: {f.split("/data/")[1] for f in paths} for name, paths in found.items()})
    first, second, third, fourth = files
    assert {f.split("/")[1] for f in first["books"] ^ second["books"]} == {"bucket=3"}
    assert first["tags"] == second["tags"] == fourth["tags"] and first["books_tags"] == fourth["books_tags"]
    assert third == fourth == second  # a book that comes back stays inactive, as before
    rows = {r["id"]: r["active"] for r in jobs.catalogue_table(spark, lake, "books").collect()}
    assert [i for i, active in rows.items() if not active] == [75]


def test_warehouse(spark, small, lake):
    ui, rec = domain.ui_history(spark, small), domain.rec_history(spark, small)
    jobs.warehouse_etl(spark, ui.where("timestamp < 1705363200"), rec, lake)
    jobs.warehouse_etl(spark, ui, rec, lake)
    rejected = spark.read.parquet(f"{lake}/fact_user_interaction_rejects").count()
    assert rejected == ui.where("action = 'signup'").count()
    jobs.warehouse_etl(spark, ui, rec, lake)
    assert spark.read.parquet(f"{lake}/fact_user_interaction_rejects").count() == rejected
    stored = jobs.facts(spark, lake, "fact_user_interaction")
    assert stored.count() == ui.where("action <> 'signup'").count()
    assert jobs.facts(spark, lake, "fact_recommendation").count() == rec.count()
    outcome = warehouse.rec_outcome_by_action(
        jobs.facts(spark, lake, "fact_recommendation"), stored, warehouse.dim_time(spark), warehouse.dim_action(spark)
    )
    assert outcome.agg(F.sum("total_no_interaction")).first()[0] > 0


def test_training_and_serving(spark, small, lake, tmp_path):
    adapter_losses = jobs.train_adapter(spark, lake, output_dim=8, epochs=2, steps_per_epoch=2, warm_up=1)
    assert adapter_losses[-1] < adapter_losses[0]
    ui = domain.ui_history(spark, small)
    losses = jobs.train_policy(spark, ui, lake, epochs=2, steps_per_epoch=2)
    assert losses[-1] < losses[0]
    model = registry.read_registry(spark, f"{lake}/model")
    assert registry.latest_payload(model, "losses") == losses
    assert registry.latest_payload(model, "metadata")["embedding_dim"] == 8
    assert registry.latest_payload(model, "optim")["updates"] == 4
    assert jobs.train_policy(spark, ui, lake, epochs=1, steps_per_epoch=2)[0] < losses[-1]
    model = registry.read_registry(spark, f"{lake}/model")
    assert registry.latest_payload(model, "optim")["updates"] == 6
    ids = [r["id"] for r in model.select("id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert len({json.loads(r["weights"])["path"] for r in model.where("type = 'weights'").collect()}) == 2
    items, params = jobs.serving_model(spark, lake)
    states = sessions.last_state(sessions.reward_strict(ui)[0])
    found = policy.recommend(states, policy.load_params(items, params))
    assert found.count() == 5 * states.count()


def test_drain_reads_each_event_once(spark, tmp_path):
    session = streaming_session(spark)
    (tmp_path / "log").mkdir()
    line = '{"sid": "s", "uid": 1, "bid": 2, "action": "click", "timestamp": %d}\n'
    for day in range(3):
        (tmp_path / "log" / f"{day}.json").write_text(line % day * 2)
        stream.drain_log(session, str(tmp_path / "log"), str(tmp_path / "history"), str(tmp_path / "checkpoint"))
        drained = session.read.parquet(str(tmp_path / "history"))
        assert sorted(r["timestamp"] for r in drained.collect()) == sorted(list(range(day + 1)) * 2)
