"""What a stage leaves behind in the memory of an executor: its workers live on beside those of the next stage."""

import os

import numpy as np
import pytest
from test_groups import rows_with_copies

from lectern.llm import arrays, exact, mixing

PAGE = os.sysconf("SC_PAGE_SIZE")


def resident():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * PAGE


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads /proc")
def test_a_task_gives_back_what_it_no_longer_uses():
    pins = []

    def task(batches):
        held = [np.ones(8_000) for _ in range(1_600)]  # 100 MB in blocks that the C library keeps
        pins.append(np.ones(8_000))  # above them, so that the heap cannot shrink from its end
        pins.append(resident())
        held.clear()
        yield from batches

    assert list(arrays.releasing(task)(iter([1]))) == [1]
    assert pins[1] - resident() > 80e6


def test_powers_are_kept_for_light_slices_only(monkeypatch):
    monkeypatch.setattr(arrays, "_powers", {})
    up, down = arrays.powers(arrays.LIGHT_SLICE_BYTES)
    assert len(up) == len(down) < arrays.SLICE_BYTES // 2
    more, _ = arrays.powers(arrays.SLICE_BYTES)
    assert len(more) > arrays.SLICE_BYTES and (more[: len(up)] == up).all()


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_small_tables_of_the_driver_start_no_other_workers(documents):
    rows = [(d, t, None, ("a", "b", None)[i % 3]) for i, (d, t) in enumerate(rows_with_copies())]
    df = documents(rows)
    light = mixing.sized(mixing.numbered(df), "source").drop("carried")
    assert "ExistingRDD" not in plan_of(mixing.planned(light, mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS))
    assert mixing.planned(light.where("false"), mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS).count() == 0
    groups = exact.numbered(df).select("carried.doc_id", exact.digest("carried.text").alias("digest"), "row")
    heavy = exact.frequent(groups.withColumnRenamed("doc_id", "id"), counters=20)
    assert "ExistingRDD" not in plan_of(heavy)
    assert max(r["group_size"] for r in heavy.collect()) > 60
