import inspect
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.operators import adapter, embedding, gradients, policy, registry, sessions, triplets
from lectern.plans import queries

rng = np.random.default_rng(4)


# --- triplets ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_other(spark, block_rows):
    vectors = rng.integers(-2, 3, (40, 3)).astype(float)  # many equal distances and equal vectors
    rows = [(i, f"t{i}", [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, "none", None)]
    tags = spark.createDataFrame(rows, "id int, name string, tag_embed array<float>")
    found = {r["id"]: r for r in triplets.nearest_other(tags, block_rows).collect()}
    assert sorted(found) == list(range(40))
    for i, v in enumerate(vectors):
        distance, neg = min((round(float(np.linalg.norm(v - w)), 12), j) for j, w in enumerate(vectors) if j != i)
        assert found[i]["neg_id"] == neg and found[i]["distance"] == pytest.approx(distance)


def test_single_tag_keeps_its_rows(spark):
    tags = spark.createDataFrame([(1, [1.0, 0.0])], "id int, tag_embed array<float>")
    bridge = spark.createDataFrame([(10, 1), (11, 1)], "book_id int, tag_id int")
    books = spark.createDataFrame([(10, [1.0, 1.0]), (11, None)], "id int, summary_embed array<float>")
    found = triplets.mine_triplets(tags, bridge, books).orderBy("book_id").collect()
    assert [(r["book_id"], r["neg"], r["pos"]) for r in found] == [(10, None, [1.0, 1.0]), (11, None, None)]


def test_evaluate(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]), (2, [1.0, 0.0], None, [0.0, 1.0]), (3, [0.0, 0.0], [1.0, 0.0], [1.0, 1.0])]
    data = spark.createDataFrame(rows, "k int, anchor array<float>, pos array<float>, neg array<float>")
    swap = np.array([[1.0, 0.0], [0.0, 10.0]])
    found = triplets.evaluate_triplets(data, swap, np.zeros(2)).orderBy("k").collect()
    assert found[0]["distance_pos"] == pytest.approx(1 - 1 / math.sqrt(1.01), abs=1e-6) and found[0]["distance_neg"] == 1.0
    assert found[0]["adapted_distance_pos"] == pytest.approx(1 - 1 / math.sqrt(2), abs=1e-6) and found[0]["res"] == 1
    assert found[1]["distance_pos"] is None and found[1]["res"] == 0
    assert math.isnan(found[2]["distance_pos"]) and found[2]["res"] == 0
    counts = {r["res"]: r["count"] for r in triplets.correct_triplets(triplets.evaluate_triplets(data, swap, np.zeros(2))).collect()}
    assert counts == {0: 2, 1: 1}


# --- gradients --------------------------------------------------------------------------------------------


def numeric(f, x, h=1e-6):
    out = np.zeros_like(x)
    for place in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[place] += h
        down[place] -= h
        out[place] = (f(up) - f(down)) / (2 * h)
    return out


def test_triplet_gradient():
    rows = tuple(rng.normal(size=(6, 4)) for _ in range(3))
    parameters = rng.normal(size=(3, 5))
    loss, gradient = adapter.triplet_loss(parameters, rows, 0.5)
    assert loss > 0
    assert gradient == pytest.approx(numeric(lambda p: adapter.triplet_loss(p, rows, 0.5)[0], parameters), abs=1e-5)


def test_policy_gradient():
    states, theta = rng.normal(size=(7, 3)), rng.normal(size=(4, 3))
    actions, returns, sizes = rng.integers(0, 4, 7), rng.normal(size=7), np.array([3, 3, 3, 2, 2, 1, 1])
    _, gradient = policy.reinforce_loss(theta, states, actions, returns, sizes, 0.3)
    by_hand = numeric(lambda t: policy.reinforce_loss(t, states, actions, returns, sizes, 0.3)[0], theta)
    assert gradient == pytest.approx(by_hand, abs=1e-5)


def test_policy_loss_by_hand():
    states, theta = np.array([[1.0, 0.0]]), np.array([[0.0, 0.0], [math.log(3), 0.0]])
    loss, _ = policy.reinforce_loss(theta, states, np.array([1]), np.array([2.0]), np.array([4]), 0.01)
    entropy = -(0.25 * math.log(0.25) + 0.75 * math.log(0.75))
    assert loss == pytest.approx(-2 * math.log(0.75) - 0.01 * entropy / 4)


@pytest.mark.parametrize("few, slot", [(16, 131_072), (1, 131_072), (1, 3)])
def test_total_gradient(spark, monkeypatch, few, slot):
    monkeypatch.setattr(gradients, "FEW", few)
    monkeypatch.setattr(gradients, "SLOT", slot)

    def add(batch):
        ids = np.array(batch.column("id").to_pylist(), dtype=float)
        return float(len(ids)), ids.sum() * np.arange(8.0)

    loss, gradient = gradients.total_gradient(spark.range(0, 1000, numPartitions=9), add, 8)
    assert loss == 1000 and gradient.tolist() == [499500.0 * n for n in range(8)]


def test_schedule_and_clip():
    assert [gradients.warm_up_then_decay(s, 4, 8) for s in (0, 2, 4, 6, 8)] == [0, 0.5, 1, 0.5, 0]
    assert [gradients.warm_up_then_decay(s, 0, 4) for s in (0, 1, 4)] == [1, 0.75, 0]
    assert [gradients.warm_up_then_decay(s, 100, 30) for s in (0, 25)] == [0, 0.25]
    assert np.linalg.norm(gradients.clipped(np.array([3.0, 4.0]), 1.0)) == pytest.approx(1.0)
    assert gradients.clipped(np.array([0.3, 0.4]), 1.0).tolist() == [0.3, 0.4]


def test_fit_adapter_losses_is_the_whole_fit(spark, small, monkeypatch):
    given = []

    def fit(*args, **settings):
        given.append(inspect.signature(adapter.fit_adapter).bind(*args, **settings).arguments)
        return None, None, [1.0]

    monkeypatch.setattr(queries, "fit_adapter", fit)
    queries.QUERIES["fit_adapter_losses"](spark, small)
    assert [list(arguments) for arguments in given] == [["triplets"]]  # every other argument keeps its default


def test_fit_adapter(spark):
    centres = rng.normal(size=(3, 6))
    rows = []
    for n in range(60):
        kind = n % 3
        near, far = centres[kind] + 0.8 * rng.normal(size=6), centres[(kind + 1) % 3] + 0.8 * rng.normal(size=6)
        rows.append(tuple([float(x) for x in v] for v in (centres[kind], near, far)))
    data = spark.createDataFrame([*rows, (rows[0][0], None, rows[0][2])], "anchor array<float>, pos array<float>, neg array<float>")
    weights, bias, losses = adapter.fit_adapter(data, 3, epochs=5, steps_per_epoch=2, learning_rate=0.05, warm_up=2)
    assert weights.shape == (3, 6) and bias.shape == (3,) and losses[-1] < losses[0]
    applied = adapter.apply_adapter(data, "pos", weights, bias, "out").collect()
    for row in applied:
        if row["pos"] is None:
            assert row["out"] is None
        else:
            assert row["out"] == pytest.approx((weights @ row["pos"] + bias).tolist(), abs=1e-5)


# --- policy -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(spark):
    vectors = rng.normal(size=(30, 4)).round(2)
    rows = [(2 * i + 1, 100 + i, None if i == 7 else [float(x) for x in v]) for i, v in enumerate(vectors)]
    books = spark.createDataFrame(rows, "idx int, id int, summary_embed array<float>")
    items = policy.policy_items(books)
    states = [
        ("a", 1, [(1, 100, 1), (1, 103, 2)]), ("b", 2, [(2, 104, -1), (2, 107, 1), (2, 999, 2)]), ("c", 3, []), ("d", 4, [(4, 105, 0)]),
    ]
    kind = "sid string, uid int, last array<struct<uid: int, bid: int, reward: int>>"
    return {r[1]: r[2] for r in rows}, items, spark.createDataFrame(states, kind), states


def expected_states(vectors, states):
    out = {}
    for sid, _, last in states:
        total = np.zeros(4)
        for _, bid, reward in last:
            if vectors.get(bid) is not None:
                total += {1: 1.0, 2: 2.0}.get(reward, -1.0) * np.array(vectors[bid], dtype=np.float32)
        out[sid] = np.r_[total / max(1, len(last)), 1.0]
    return out


@pytest.mark.parametrize("items_per_pass", [65_536, 4])
def test_recommend(shop, items_per_pass):
    vectors, items, states, rows = shop
    loaded = policy.load_params(items, policy.initial_params, items_per_pass)
    assert loaded.block_count == (1 if items_per_pass > 30 else 8)
    found = policy.recommend(states, loaded).collect()
    for sid, state in expected_states(vectors, rows).items():
        logits = {i: float(np.array(v, dtype=np.float32) @ state[:4]) for i, v in vectors.items() if v is not None}
        mass = sum(math.exp(x) for x in logits.values())
        best = sorted(logits, key=lambda i: (-round(logits[i], 9), i))[:5]
        mine = sorted((r for r in found if r["sid"] == sid), key=lambda r: r["rank"])
        assert [r["bid"] for r in mine] == best and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r["probability"] for r in mine] == pytest.approx([math.exp(logits[i]) / mass for i in best], abs=1e-6)


def test_fit_policy_learns_the_rewarded_item(spark, shop):
    _, items, _, _ = shop
    rows = [(f"s{n % 20}", 1, 100 + (3 if n % 2 else 5), "read" if n % 2 else "skip", n, n) for n in range(200)]
    history = spark.createDataFrame(rows, "sid string, uid int, bid int, action string, timestamp long, event_id long")
    books = items.select("id", (2 * F.col("id")).cast("int").alias("idx"))
    steps = sessions.training_steps(history, books)
    matched = items.drop("item").join(sessions.item_index(books).select("id", "item"), "id")
    params, losses, _ = policy.fit_policy(steps, matched, epochs=6, steps_per_epoch=2, learning_rate=0.1)
    assert losses[-1] < losses[0]
    states = spark.createDataFrame([("x", 1, [])], "sid string, uid int, last array<struct<uid: int, bid: int, reward: int>>")
    best = policy.recommend(states, policy.load_params(matched, params)).orderBy("rank").collect()
    assert best[0]["bid"] == 103
    assert 0 < sum(r["probability"] for r in best) <= 1


def unpacked(params):
    return {r["id"]: np.array([r["theta"], r["mean"], r["square"]]) for r in params.collect()}


def test_fit_in_blocks_equals_one_block_and_resumes(spark, shop):
    _, items, _, _ = shop
    rows = [(f"s{n % 9}", 1, 100 + n * n % 30, ("read", "skip", "view")[n % 3], n, n) for n in range(120)]
    history = spark.createDataFrame(rows, "sid string, uid int, bid int, action string, timestamp long, event_id long")
    books = items.select("id", (2 * F.col("id")).cast("int").alias("idx"))
    steps = sessions.training_steps(history, books)
    matched = items.drop("item").join(sessions.item_index(books).select("id", "item"), "id")
    settings = {"steps_per_epoch": 2, "learning_rate": 0.05}
    params, losses, progress = policy.fit_policy(steps, matched, epochs=3, **settings)
    whole = unpacked(params)
    blocks, block_losses, _ = policy.fit_policy(steps, matched, epochs=3, block_items=4, **settings)
    assert block_losses == pytest.approx(losses)
    for number, values in unpacked(blocks).items():
        assert values == pytest.approx(whole[number], abs=1e-9)

    first, early, reached = policy.fit_policy(steps, matched, epochs=2, **settings)
    more, late, ended = policy.fit_policy(steps, matched, epochs=1, start=first, progress=reached, **settings)
    assert early + late == pytest.approx(losses) and ended.updates == progress.updates
    for number, values in unpacked(more).items():
        assert values == pytest.approx(whole[number], abs=1e-9)

    gone = first.where("id <> 104")
    assert len(unpacked(policy.fit_policy(steps, matched, epochs=1, start=gone, progress=reached, **settings)[0])) == len(whole)


# --- embedding --------------------------------------------------------------------------------------------


def test_hashing_encoder(spark):
    texts = ["the cat the dog", "", None, "Ünder  the\tsea"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = embedding.embed(rows, "t", "v", embedding.hashing_encoder(16)).orderBy("i").collect()
    for row in found:
        total = np.zeros(16)
        for word in (row["t"] or "").lower().split():
            hashed = xxhash.xxh64_intdigest(word.encode(), seed=42)
            signed = hashed - (1 << 64) if hashed >> 63 else hashed
            total[signed % 16] += -1.0 if (signed >> 32) & 1 else 1.0
        length = np.linalg.norm(total)
        assert row["v"] == pytest.approx((total / length if length else total).tolist(), abs=1e-6)


def test_batch_encoder_calls_in_batches(spark):
    def encode(texts):
        assert len(texts) <= 64
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.range(200).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).coalesce(1)
    found = embedding.embed(rows, "t", "v", embedding.batch_encoder(encode)).collect()
    assert len(found) == 200
    for row in found:
        assert row["v"] == pytest.approx([len(row["t"]) / math.hypot(len(row["t"]), 1), 1 / math.hypot(len(row["t"]), 1)], abs=1e-6)


# --- registry ---------------------------------------------------------------------------------------------


def test_registry(spark, tmp_path):
    path = str(tmp_path / "model")
    for n in range(4):
        registry.save_model(spark, path, "losses", [n + 0.5, n + 0.25], n)
    registry.save_model(spark, path, "metadata", {"embedding_dim": 4}, 9)
    model = registry.read_registry(spark, path)
    newest = {r["type"]: r["id"] for r in registry.latest_model(model).collect()}
    assert newest == {"losses": 3, "metadata": 9}
    curves = registry.loss_curves(model).orderBy("training_round", "epoch").collect()
    assert [(r["id"], r["epoch"], r["loss"]) for r in curves] == [
        (3, 0, 3.5), (3, 1, 3.25), (2, 0, 2.5), (2, 1, 2.25), (1, 0, 1.5), (1, 1, 1.25)
    ]
    assert registry.latest_model(model.limit(0)).count() == 0
    with pytest.raises(ValueError):
        registry.save_model(spark, path, "other", {}, 1)


def test_metadata(spark):
    books = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, summary_embed array<float>")
    assert tuple(registry.model_metadata(books).first()) == (2, 2)
