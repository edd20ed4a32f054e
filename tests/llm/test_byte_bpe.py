"""Byte-level BPE against the library that the ranks belong to."""

import base64
import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest_llm import AWKWARD

from lectern.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000, seed=1):
    rng = random.Random(seed)
    signs = ["a", "b", "s", "t", "re", "ll", "ve", "m", "'", "'", " ", " ", "\n", "\t", "1", "२", "é", "日", "!", " ", "\xa0"]
    signs += ["\U0001f600", "\x1c", "x" * 5, "̈", "ſ", "՘", "\U00011de0"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def long_texts(seed=2):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["x" * 30_000, "ab" * 3_000, " " * 3_000, " " * 3_000 + "a", "!?" * 500, "日本語" * 900]
    return made + ["".join(rng.choice(letters[:k]) for _ in range(9_000)) for k in (2, 5, 26)]


def encoded(texts, limit, memory=byte_bpe.PIECES):
    known = byte_bpe.PieceIds(RANKS, memory)
    ids, raw = [[] for _ in texts], [b""] * len(texts)
    for i, found, back in byte_bpe.encoded_parts(pa.array(texts), known, limit):
        ids[i] += found.tolist()
        raw[i] += back.tobytes()
    return ids, raw


@pytest.mark.parametrize("limit, memory", [(1 << 20, 1 << 18), (40, 1 << 18), (1 << 20, 50)])
def test_encodes_as_the_library(library, limit, memory):
    texts = odd_texts() + long_texts()
    ids, raw = encoded(texts, limit, memory)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert raw == [t.encode() for t in texts]


def test_rounds_of_a_matrix_and_of_a_long_row_agree():
    table = byte_bpe.pairs(RANKS)
    for text in long_texts():
        row = table.single[np.frombuffer(text.encode()[:400], np.uint8)]
        matrix, sizes = byte_bpe.merged(np.append(row, [-1, -1]).astype(np.int32)[None, :], table)
        assert matrix[0, : sizes[0]].tolist() == byte_bpe.merged_long(row, table).tolist()


def test_pairs_are_all_pairs_that_make_a_token():
    table = byte_bpe.pairs(RANKS)
    rng = random.Random(3)
    tokens = list(table.ranks)
    for _ in range(2_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        whole = rng.choice(tokens)
        cut = rng.randrange(len(whole) + 1)
        for left, right in ((a, b), (whole[:cut], whole[cut:])):
            if left in table.ranks and right in table.ranks:
                got = table.rank(np.array([table.ranks[left]]), np.array([table.ranks[right]]))[0]
                assert got == table.ranks.get(left + right, byte_bpe.NONE)


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_round_trip(documents, library, limit):
    rows = AWKWARD + list(enumerate(odd_texts(40), 100)) + [(900 + i, t) for i, t in enumerate(long_texts())]
    wanted = Counter()
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        wanted[doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    df = documents(rows)
    assert Counter(tuple(r) for r in byte_bpe.round_trip(df, RANKS, limit=limit).collect()) == wanted
    assert byte_bpe.round_trip(df.where("false"), RANKS).count() == 0


def test_lists_of_ids_and_back(documents, library):
    rows = AWKWARD + list(enumerate(odd_texts(30), 100))
    df = documents(rows)
    lists = byte_bpe.encoded(df, RANKS, ids="row")  # takes the place of a column of that name
    assert sorted(lists.columns) == sorted(df.columns)
    back = byte_bpe.decoded(lists, RANKS, ids="row", text="text_back")
    got = Counter((r["doc_id"], r["text"], tuple(r["row"]), r["text_back"], r["carried"]) for r in back.collect())
    assert got == Counter((d, t, tuple(library.encode_ordinary(t or "")), t or "", "x") for d, t in rows)
    odd = df.limit(1).selectExpr("array(-1, 70000, cast(null as int)) as ids").unionByName(df.limit(1).selectExpr("cast(null as array<int>) as ids"))
    assert [r["decoded"] for r in byte_bpe.decoded(odd, RANKS).collect()] == ["", ""]
    assert byte_bpe.encoded(df.where("false"), RANKS).count() == 0
