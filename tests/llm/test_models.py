"""Language, toxicity, fingerprints and chats."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from conftest_llm import AWKWARD

from lectern.llm import chats, language, sketches, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": ["the", "house", "green", "water", "with"], "de": ["das", "haus", "grün", "wasser", "mit"], "fr": ["la", "maison", "vert", "eau", "avec"]}


def segmentations(text, known):
    if not text:
        yield []
    for n in range(1, min(len(text), language.LONGEST) + 1):
        piece = known.get(text[:n], 0 if n == 1 else None)
        if piece is not None:
            for rest in segmentations(text[n:], known):
                yield [piece, *rest]


def test_sums_over_all_segmentations():
    known = language.vocabulary(PIECES)
    size = len(known) + 1
    table = np.random.default_rng(0).random((size, 2))
    for word in ("hello", "über", "日本x"):
        found = list(segmentations(language.SPACE + word, known))
        logs = language.Lattices(["zz", word], PIECES).logarithms(table, 2)[1]
        assert np.allclose(logs, [math.log(sum(math.prod(table[p, k] for p in s) for s in found)) for k in (0, 1)])
        total, uses = sum(size ** -len(s) for s in found), Counter()
        for s in found:
            for p in s:
                uses[p] += size ** -len(s) / total
        got = Counter()
        for w, p, share in zip(*language.Lattices([word], PIECES).expectations(size)):
            got[p] += share
        assert got.keys() == uses.keys() and all(got[p] == pytest.approx(uses[p]) for p in uses)


def test_language(documents):
    rng = random.Random(1)
    rows = [(100 + i, " ".join(rng.choices(WORDS[lang], k=12)), lang, None) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 150))]
    df = documents([(d, t, None, None) for d, t in AWKWARD] + rows + [(999, "1 2 3 !", "en", None)])
    got = {r["doc_id"]: r for r in language.identified(df, PIECES).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang, _ in rows)
    assert all(got[d]["lang_pred"] == "und" for d in (1, 2, 3, 999)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identified(df, PIECES).count() == df.count()
    assert language.identified(df.where("false"), PIECES).count() == 0
    assert {r["lang_pred"] for r in language.identified(df.where("lang is null"), PIECES).collect()} == {"und"}


def toxic_rows():
    rng = random.Random(2)
    clean = ["river", "stone", "walking", "green", "letter", "window", "music", "paper", "along", "summer"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=20)
        if i % 4 == 0:
            words[rng.randrange(20)] = rng.choice(["idiot", "scumbag"])
        rows.append((i, " ".join(words)))
        labels.append((i, i % 4 == 0))
    return rows, labels


def test_toxicity(spark, documents):
    rows, labels = toxic_rows()
    hidden = ["river id1ot stone", "music i d i o t paper", "along idiooot window", "letter 5cumbag green", "stone i.d.i.o.t paper"]
    fine = ["river stone walking", "window music a b c paper", "green 1234 letter!!!"]
    odd = [(1000 + (d or 0), t) for d, t in AWKWARD] + [(None, "river")]
    df = documents(rows + odd + [(2000 + i, t) for i, t in enumerate(hidden)] + [(3000 + i, t) for i, t in enumerate(fine)])
    frame = spark.createDataFrame([(d, 0, int(k)) for d, k in labels] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(df, frame).collect()}
    assert all(got[d]["predicted"] == int(k) for d, k in labels)
    assert [got[2000 + i]["predicted"] for i in range(len(hidden))] == [1] * len(hidden)
    assert [got[3000 + i]["predicted"] for i in range(len(fine))] == [0] * len(fine)
    left = toxicity.accepted(df, frame)
    assert left.columns == df.columns and left.count() == df.count() - 100 - len(hidden)
    assert toxicity.scored(df.where("false"), frame).count() == 0
    assert toxicity.scored(df, frame.where("false")).where("predicted = 1").count() == 0


def test_disguises_that_need_whole_tokens(spark, documents):
    rows, labels = toxic_rows()
    hidden = ["river id!ot stone", "music i d ! o t paper", "along idiiot window", "letter id.iot green", "music 5 c u m 8 a g paper",
              "stone (i d!o t! paper", "river idiiot. stone", "along i.d i.o t window"]
    fine = ["letter summer walking green", "river,stone! walking.", "window 2 6 8 9 music", "paper a! b? c. along"]
    df = documents(rows + [(2000 + i, t) for i, t in enumerate(hidden)] + [(3000 + i, t) for i, t in enumerate(fine)])
    frame = spark.createDataFrame([(d, 0, int(k)) for d, k in labels], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(df, frame).collect()}
    assert [got[2000 + i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [got[3000 + i] for i in range(len(fine))] == [0] * len(fine)


def test_character_model_keeps_all_triples(documents):
    rng = random.Random(7)
    words = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(3_500)) for _ in range(60)]
    wanted = Counter(f"##{w}#"[i : i + 3] for w in words for i in range(len(w) + 1))
    assert len(wanted) > 200_000
    rows = toxicity.texts_of(documents(list(enumerate(words))), "text", "doc_id")
    model = toxicity.Model(rows, chunk=100_000)
    three = model.characters().three
    letters = ["".join(map(chr, (k >> 42, (k >> 21) & toxicity.LETTER, k & toxicity.LETTER))) for k in three.keys.tolist()]
    assert len(model.chunks) > 1 and dict(zip(letters, three.times.tolist())) == wanted


def test_all_evidence_is_weighed(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(("abcdefghijklm", "nopqrstuvwxyz")[k % 2]) for k in range(12)) for _ in range(5_000)]
    bad = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    rows = spark.createDataFrame([(t, 1.0) for t in bad * 4] + [("river stone walking", 0.0)] * 400, "text string, toxic double")
    known = toxicity.evidence(rows, toxicity.Model(rows))
    assert len(words) > 4_096 and set(words) <= set(known) and "river" not in known


def test_sketches(documents):
    rng = random.Random(5)
    rows = AWKWARD + [(20 + i, "".join(rng.choice("abcé日 ") for _ in range(rng.choice((5, 10, 19, 20, 21, 400))))) for i in range(60)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {(r["doc_id"], r["n_chars"]): r for r in sketches.fingerprints(documents(rows)).collect()}
    plain = [(d, t or "") for d, t in order]
    for (d, t), (e, after) in zip(plain, plain[1:] + plain[:1]):
        r = got[d, len(t)]
        if None in (d, e) or 7 in (d, e):
            continue  # rows of one id follow in the order of a hash
        m = len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        assert r["fingerprint"] == sketches.written_out(sketches.kept(sketches.hashes(t)))
        assert r["edited_fingerprint"] == sketches.written_out(sketches.kept(sketches.hashes(edited)))
        a, b, c = (sketches.kept(sketches.hashes(x)) for x in (t, edited, after))
        assert (r["near_edited"], r["near_next"]) == (sketches.likeness(a, b), sketches.likeness(a, c))
    assert sketches.fingerprints(documents(rows)).count() == len(rows)
    assert sketches.fingerprints(documents(rows).where("false")).count() == 0
    x, y = "the quick brown fox " * 30, "jumps over the lazy dog " * 30
    assert set(sketches.merged(*(sketches.kept(sketches.hashes(t)) for t in (x, y)))) <= set(sketches.kept(sketches.hashes(x + y)))


def plain_sketch(text, size=10, fraction=16):
    """Shingles of a text whose hash is below the fraction, by sets of strings and one hash at a time."""
    runs = {text[i : i + size] for i in range(max(len(text) - size + 1, 1))} if text else set()
    values = {int(sketches.hashes(run, size)[0]) for run in runs}
    below = {v for v in values if v < (1 << 64) // fraction}
    return below or ({min(values)} if values else set())


def test_stored_sketches_merge_and_contain(spark, documents):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé日") for _ in range(5)) for _ in range(400)]
    long = " ".join(rng.choices(words, k=3000))
    rows = [(1, long), (2, long[4000:6000]), (3, " ".join(rng.choices(words, k=300))), (4, "tiny"), (5, ""), (6, None), (7, long[100:130])]
    stored = sketches.fingerprints(documents(rows)).select("doc_id", "fingerprint")
    found = {r["doc_id"]: set(sketches.read_back(r["fingerprint"]).tolist()) for r in stored.collect()}
    assert found == {d: plain_sketch(t or "") for d, t in rows}
    groups = stored.selectExpr("doc_id % 2 as part", "fingerprint").groupBy("part").agg(sketches.together("fingerprint").alias("whole"))
    for row in groups.collect():
        values = set().union(*(found[d] for d, _ in rows if d % 2 == row["part"]))
        below = {v for v in values if v < (1 << 64) // 16}
        assert set(sketches.read_back(row["whole"]).tolist()) == (below or {min(values)})
    pairs = stored.alias("a").join(stored.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), sketches.contained("a.fingerprint", "b.fingerprint").alias("part")
    )
    got = {(r["x"], r["y"]): r["part"] for r in pairs.collect()}
    assert got[1, 2] > 0.95 and got[1, 3] < 0.2 and got[5, 6] == 1.0 and got[1, 5] == 0.0
    for (x, y), part in got.items():
        a, b = found[x], found[y]
        assert part == (len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b)))


def test_chats(spark):
    def log(conv, *turns):
        return [(conv, i, "user" if i % 2 == 0 else None, text) for i, text in enumerate(turns)]

    rows = log(1, "hi") + log(2, "hi", "yes") + log(3, "hi", "yes", "bye") + log(4, "hi", "no") + log(5, "hi", "no") + log(6, None, "x")
    rows += log(7, "hi", "yes")[1:] + log(None, "alone") + log(3, "hi")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chats.chats(df).collect()}
    assert set(got) == {3, 4, 6, 7, None}
    assert got[4][:2] == (2, 2) and got[3][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>\nyes<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert chats.chats(df.where("false")).count() == 0
