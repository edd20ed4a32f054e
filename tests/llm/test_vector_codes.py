"""Codes of vectors against plain Python with unbounded integers, and trees against all distances."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from lectern.llm import vector_codes

NAMES = ("code", "error", "vector", "trees", "label_key", "part")  # clash with the operator's own
SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(name, T.StringType()) for name in NAMES],
    ]
)


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next((len(r[1]) for r in order if len(r[1]) % parts == 0), 0)
    held = [max(-(2**62), min(2**62, math.floor(Fraction(x) * 256))) for _, v, _ in order for x in v if len(v) == width]
    cut = width // parts
    vectors = [[held[i + p * cut : i + (p + 1) * cut] for p in range(parts)] for i in range(0, len(held), width or 1)]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for v in vectors]

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v, (_, k) in zip(vectors, assigned(p)):
                own[k].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    found = list(zip(*(assigned(p) for p in range(parts))))
    at = iter(found)
    out, sums = [], {}
    for i, v, label in order:
        code = error = None
        if len(v) == width:
            best = next(at)
            code, error = "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1)
            sums[label] = sums.get(label, 0) + error
        out.append((i, label, code, error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, min(sums[label], 2**63 - 1) if label in sums else None, digest) for i, label, c, e in out)


def vectors(n=300, width=32, seed=5, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(9)]
    made = [[x + rng.choice((0, 0.001, 0.3)) * rng.gauss(0, scale) for x in rng.choice(centres)] for _ in range(n)]
    return [(i, v, rng.choice((None, 1, 2, 2, 2))) for i, v in enumerate(made)]


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [1.0] * 31 + [None], 1), (1003, [float("nan")] * 32, 1), (1004, [float("inf")] * 32, 1),
    (1005, [0.5] * 16, 7), (1006, [0.5] * 31, 2), (None, [0.25] * 32, None), (None, [0.25] * 32, 3), (3, [-0.001] * 32, 2),
    (3, [-0.001] * 32, 2), (-5, [1e-9] * 32, 4),
]


@pytest.mark.parametrize("numbers", [1 << 19, 32 * 40])
def test_equals_plain_python(spark, monkeypatch, numbers):
    monkeypatch.setattr(vector_codes, "BLOCK_NUMBERS", numbers)
    rows = vectors() + ODD
    df = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in vector_codes.compressed(df).collect()) == plain(rows)


@pytest.mark.parametrize("big", [3e6, 1e9, 1e25])
def test_numbers_beyond_64_bit_distances(spark, big):
    rows = vectors(90) + [(500, [big] * 32, 1), (501, [-big] + [0.5] * 31, 1), (2, [big, 1.0] * 16, None)]
    df = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], SCHEMA).repartition(2)
    assert Counter(tuple(r) for r in vector_codes.compressed(df).collect()) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(5)
    df = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], SCHEMA)
    assert Counter(tuple(r) for r in vector_codes.compressed(df).collect()) == plain(rows)
    assert vector_codes.compressed(df.where("false")).count() == 0
    short = [(1, [1.0] * 5, None), (2, [2.0] * 7, 1)]
    df = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in short], SCHEMA)
    assert Counter(tuple(r)[:4] for r in vector_codes.compressed(df).collect()) == Counter([(1, None, None, None), (2, None, None, None)])


@pytest.mark.parametrize("kind", ["normal", "clusters", "copies", "spread", "same"])
def test_walks_equal_all_distances(kind):
    rng = np.random.default_rng(7)
    points = {
        "normal": rng.normal(0, 40, (3000, 4)),
        "clusters": np.repeat(rng.normal(0, 300, (50, 4)), 40, axis=0) + rng.normal(0, 2, (2000, 4)),
        "copies": np.repeat(rng.integers(-3, 3, (30, 4)), 60, axis=0),
        "spread": np.exp(rng.normal(0, 5, (1000, 4))),
        "same": np.ones((400, 4)),
    }[kind]
    points = np.floor(points).astype(np.int64)
    entries = points[rng.permutation(len(points))[:64]]
    tree = vector_codes.Tree.unpacked(vector_codes.grown(points).packed())
    walk = vector_codes.Walk(tree, entries)
    distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)
    code, error = walk.codes()
    assert (code == best).all() and (error == distance.min(axis=1)).all()
    count, total = walk.sums()
    assert (count == np.bincount(best, minlength=64)).all()
    assert all((total[k] == points[best == k].sum(axis=0)).all() for k in range(64))
    # Every ball holds its points, and sums and counts are those of its children.
    for b in np.flatnonzero(tree.left >= 0):
        children = [tree.left[b], tree.right[b]]
        assert tree.count[b] == tree.count[children].sum() and (tree.total[b] == tree.total[children].sum(axis=0)).all()
    leaves = np.flatnonzero(tree.left < 0)
    assert sorted(i for b in leaves for i in range(tree.begin[b], tree.end[b])) == list(range(len(points)))
    for b in leaves:
        own = tree.points[tree.begin[b] : tree.end[b]]
        assert (vector_codes.lengths(own - tree.center[b]) <= tree.radius[b] + 1e-9).all()


def test_wholly_owned_balls_are_not_opened():
    rng = np.random.default_rng(8)
    points = np.repeat(rng.integers(-9000, 9000, (20, 4)), 100, axis=0) + rng.integers(-3, 4, (2000, 4))
    walk = vector_codes.Walk(vector_codes.grown(points), points[::100].copy())
    opened = sum((walk.tree.end[leaves] - walk.tree.begin[leaves]).sum() for _, _, leaves, _ in walk.levels(True))
    assert opened < 100
