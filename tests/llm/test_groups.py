"""Exact copies, near copies, repeated substrings and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from lectern.llm import exact, jaccard, mixing, substrings

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_with_copies(n=120, seed=4):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 2, 3)) for _ in range(rng.choice((3, 30, 120)))) for _ in range(n // 4)]
    shared = " ".join(rng.choice("pqrstu") * 2 for _ in range(90))
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = rng.choice("xyz") * 2
        text = " ".join(words)
        rows.append((i, text + " " + shared if rng.random() < 0.2 else text.title() if rng.random() < 0.1 else text))
    return rows + [(500 + i, rows[0][1]) for i in range(60)]


@pytest.mark.parametrize("counters", [2, 1000])
def test_exact_groups(documents, counters):
    rows = AWKWARD + rows_with_copies()
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    wanted = Counter()
    for d, t in rows:
        own = groups[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        wanted[d, keep, len(own), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()] += 1
    got = exact.exact_groups(documents(rows), counters=counters).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == wanted
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["id"] == r["keep_id"] for r in kept)


def test_without_copies(documents):
    rows = AWKWARD + rows_with_copies()
    df = documents(rows)
    left = exact.without_copies(df)
    assert left.columns == df.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t in rows})
    assert exact.without_copies(df.where("false")).count() == 0


def components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("few, tile", [(8, 16 << 20), (1, 2048)])
def test_jaccard_join(documents, monkeypatch, few, tile):
    rows = AWKWARD + rows_with_copies()
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile)
    got = Counter(tuple(r) for r in jaccard.join(documents(rows)).collect())
    assert got == Counter(components(rows, 4, 85))


def test_without_near_copies(documents):
    rows = rows_with_copies(60, seed=9)
    df = documents(rows)
    left = jaccard.without_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c if n else d for d, n, c in components(rows, 5, 80)})
    assert jaccard.without_near_copies(df.where("false")).count() == 0


def test_without_near_copies_where_ids_repeat(documents):
    def text(letter, *others):
        return " ".join([*others, *(f"{letter}{i}" for i in range(60))])

    rows = [(3, text("a", "new")), (5, text("a")), (5, text("b")), (9, text("b", "new"))]  # two groups that share an id
    rows += [(20, text("c")), (20, text("c", "new")), (21, text("c", "c0"))]               # the smallest id twice
    rows += [(None, text("d")), (None, text("d", "new")), (None, text("e")), (30, text("e", "new"))]
    rows += [(40, text("f")), (40, text("f")), (None, None), (None, ""), (50, "")]
    left = Counter((r["doc_id"], r["text"]) for r in jaccard.without_near_copies(documents(rows)).collect())
    wanted = Counter([rows[0], rows[2], rows[10], rows[11], *rows[13:]])
    assert left - wanted in (Counter([rows[4], rows[7]]), Counter([rows[4], rows[8]]), Counter([rows[5], rows[7]]), Counter([rows[5], rows[8]]))
    assert not wanted - left


def removed(rows, length):
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("part, shard", [(4 << 20, 2 << 20), (600, 1 << 20)])
def test_repeated_substrings(documents, monkeypatch, part, shard):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    monkeypatch.setattr(substrings.repeats, "__defaults__", (part,))
    rows = [(d, t) for d, t in AWKWARD if d not in (9, 10)] + rows_with_copies() + [(900, "ab" * 700), (901, "zab" + "ab" * 150)]
    got = Counter(tuple(r) for r in substrings.deduplicated(documents(rows)).collect())
    assert got == Counter(removed([(d, (t or "").encode()) for d, t in rows], 200))
    assert substrings.deduplicated(documents(rows).where("false")).count() == 0


def test_targets():
    found = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 10})
    assert found["a"] == 20 and found["c"] == 20 and found["b"] == 200 and found[None] == pytest.approx(1680 - 240)
    assert mixing.targets({}) == {}


def test_flow_uses_fresh_words_first():
    # Source 0 shares its pattern with source 1, which has another one of its own: it gives way.
    given = mixing.flow([100, 100], [([0, 1], 100), ([1], 100)], 2)
    assert given[0] == [100, 0] and given[1] == [0, 100]
    given = mixing.flow([150, 100], [([0, 1], 100), ([1], 100)], 2)
    assert given[0][0] == 150 and given[1][1] == 100


def test_mix(documents):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["b", "a", None, "c", "c", "c"])) for i in range(400)]
    rows += [(None, None, None, "a"), (5, "", None, None)]
    df = documents(rows)
    got = mixing.mixed(df).selectExpr("carried.doc_id", "carried.source", "size as words", "source_size", "target", "copies").collect()
    again = mixing.mixed(df.repartition(5)).selectExpr("carried.doc_id", "carried.source", "size as words", "source_size", "target", "copies").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["words"]
        taken[r["source"]] += r["words"] * r["copies"]
    wanted = mixing.targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
    assert all(abs(taken[s] - wanted[s]) <= 3 for s in sizes)
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns and mix.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(df.where("false")).count() == 0


def test_unrelated_sets_that_share_one_shingle_make_no_group(spark):
    rng = np.random.default_rng(11)
    sets = [np.sort(np.append(rng.integers(1, 2**63, 39).astype(np.uint64), np.uint64(5))) for _ in range(30)]
    rows = [(v, 40, [5, v + 100], jaccard.bitmap(own, jaccard.slots(40)).tobytes()) for v, own in enumerate(sets)]
    base = spark.createDataFrame(rows, "vertex long, n long, prefix array<long>, bits binary")
    assert jaccard.ties(base, base.select("vertex", "n", "bits"), 85).count() == 0
    copies = base.withColumn("vertex", F.col("vertex") + 100).union(base)  # of each set one that is linked
    found = {tuple(r) for r in jaccard.ties(copies.where("vertex % 100 < 15"), copies.select("vertex", "n", "bits"), 85).collect()}
    assert found == {(v + 100, v) for v in range(15)}
