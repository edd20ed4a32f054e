"""Words and their variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import AWKWARD

from lectern.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows):
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counted[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(rows):
    counted = words_of(rows)
    out = {}
    for w, n in counted.items():
        around = sorted((-m, x) for x, m in counted.items() if near(w, x))
        form = around[0][1] if around and -around[0][0] >= 2 * n else None
        out[w] = [form, w, n, len(around), counted[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def rows(n=60, seed=3, letters="abcéÉÀ÷nxm"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice((4, 5, 6, 7, 9)))) for _ in range(30)] + ["the" * 12, "q" * 70]
    made = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 120)):
            w = rng.choice(base[: rng.choice((3, 10, 32))])
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]))
            words.append(w.title() if rng.random() < 0.2 else w)
        made.append((i, "".join(w + rng.choice((" ", "1", "'", " 日 ", "Ā", "\n")) for w in words)))
    return made + [(None, made[3][1]), (None, made[3][1]), (7, made[3][1])]


@pytest.mark.parametrize("limit, held, asked", [(1 << 18, 50_000, 250_000), (40, 7, 11)])
def test_variants(documents, limit, held, asked):
    given = AWKWARD + rows()
    wanted = plain(given)
    assert any(r[1] for r in wanted) and any(r[1] not in (None, r[2]) for r in wanted)
    got = spelling.variants(documents(given), limit=limit, held=held, asked=asked).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_no_words(documents):
    assert spelling.variants(documents(AWKWARD).where("false")).count() == 0
    assert spelling.variants(documents([(1, None), (2, "a b"), (3, "12345 日本語日本語")])).count() == 0


def test_long_words_and_hot_shard(documents):
    """A third of all words in one shard, and words longer than the matrices are wide."""
    rng = random.Random(5)
    words = {"zzz" + "".join(rng.choice("mny") for _ in range(6)) for _ in range(200)}
    long = ["ab" * 40, "ab" * 40 + "c", "ab" * 30 + "cb" + "ab" * 9, "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    given = [(i, " ".join(sorted(words) + long)) for i in range(4)]
    got = spelling.variants(documents(given), held=20, asked=30).collect()
    assert {tuple(r) for r in got} == plain(given)


def test_checksum_of_two_parts():
    tables = spelling.shift_tables()
    rng = random.Random(1)
    for size in range(0, spelling.TABLED + 1, 7):
        head, tail = rng.randbytes(9), rng.randbytes(size)
        before = zlib.crc32(head)
        joined = zlib.crc32(tail)
        for place in range(4):
            joined ^= int(tables[size, place, (before >> (8 * place)) & 255])
        assert joined == zlib.crc32(head + tail)


def test_search_finds_all_words_within_the_budget():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgmnop") for _ in range(rng.choice((5, 6)))) for _ in range(500)})
    points, offsets = spelling.spelled(pa.array(words))
    counts, size = spelling.vectors(points, offsets), np.diff(offsets)
    trie = spelling.Trie(np.zeros(len(words), np.int64), counts)  # one shard: budgets are spent on the other levels only
    flat = np.full(len(words), 1, np.int8)
    found = {(int(a), int(b)) for x, y in trie.search(np.zeros(len(words), np.int64), counts, flat, flat) for a, b in zip(x, y)}
    change = counts[None, :, spelling.TOP :] - counts[:, None, spelling.TOP :]
    within = (np.maximum(change, 0).sum(axis=2) <= 1) & (np.maximum(-change, 0).sum(axis=2) <= 1)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(within))))
    assert size.min() == 5
