"""Paths through lattices of disguised words against all paths, and lattices of any length."""

import random

import numpy as np
import pytest

from lectern.llm import toxicity
from lectern.llm.toxicity import EDGE

WORDS = ["idiot"] * 30 + ["idea"] * 20 + ["iota"] * 10 + ["tea"] * 40 + ["add"] * 15 + ["oat", "dot", "bat", "lit"] * 5


@pytest.fixture(scope="module")
def characters():
    return toxicity.Characters(*counted(WORDS))


def counted(words):
    keys, _ = toxicity.triples(words)
    return keys, np.ones(len(keys))


def all_paths(characters, text):
    """The least cost of every string that a path through the lattice of `text` spells."""
    paths = {(EDGE, EDGE, ""): 0.0}
    for i in range(len(text)):
        found = {}
        for (a, b, out), cost in paths.items():
            for letter, extra in characters.options(text, i):
                if letter == "" or (letter == EDGE and b == EDGE):
                    key, total = (a, b, out), cost + extra
                else:
                    state = (EDGE, EDGE) if letter == EDGE else (b, letter)
                    key, total = (*state, out + letter), cost + extra + characters.cost(a, b, letter)
                found[key] = min(found.get(key, np.inf), total)
        paths = found
    least = {}
    for (a, b, out), cost in paths.items():
        cost += characters.cost(a, b, EDGE) if b != EDGE else 0.0
        least[out] = min(least.get(out, np.inf), cost)
    return least


def test_restored_is_the_cheapest_of_all_paths(characters):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("iddoott14a!-. 0é") for _ in range(rng.randrange(1, 8)))
        least = all_paths(characters, text)
        assert least[characters.restored(text)] == pytest.approx(min(least.values())), text


@pytest.mark.parametrize("window", [1, 3, 7, 50])
def test_settling_what_paths_share_changes_nothing(characters, monkeypatch, window):
    rng = random.Random(2)
    texts = ["".join(rng.choice("iddoott14a!-. 0") for _ in range(60)) for _ in range(30)]
    whole = [characters.restored(text) for text in texts]
    monkeypatch.setattr(toxicity, "SETTLED", window)
    assert [characters.restored(text) for text in texts] == whole


@pytest.mark.parametrize("dashes", [10, 4_000, 4_093, 20_000])
def test_words_behind_long_noise_are_found(characters, dashes):
    assert "idiot" in characters.words("-" * dashes + "id1ot")
    assert "idiot" in characters.words("-" * dashes + "id1ot" + "-" * 5_000)


def test_counts_equal_plain_ones():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 50, 300)
    times = rng.integers(1, 5, 300).astype(float)
    for order in (np.arange(300), np.argsort(keys, kind="stable")):
        counts = toxicity.Counts(keys[order], times[order])
        assert counts.keys.tolist() == sorted(set(keys.tolist()))
        assert all(counts.of(int(k)) == times[keys == k].sum() for k in range(-1, 52))
    assert toxicity.Counts(np.empty(0, np.int64), np.empty(0)).of(3) == 0.0


def test_ordinary_tokens_pass_without_looking_for_disguise(characters, monkeypatch):
    model = characters
    slow = {token: (model.words(token), toxicity.singles(token)) for token in ("İ", "a!", "k!ll", "aaa", "x.y", "...", "")}
    assert slow["x.y"][1] == [ord("x"), ord("y")] and slow["aaa"][1] == [0] and slow["a!"][1] == [ord("a")]

    def unexpected(*_):
        raise AssertionError("looked at")

    monkeypatch.setattr(toxicity, "single", unexpected)
    monkeypatch.setattr(toxicity, "SUSPECT", None)
    for token, word in (("Plain", "plain"), ("word,", "word"), ("ÉTAIT?!", "était")):
        assert toxicity.singles(token) == [0] and model.words(token) == [word]
