"""Token files and BPE against the tokenizers library, text by text."""

import glob
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import AWKWARD
from tokenizers import Tokenizer

from lectern.llm import bpe, token_files
from lectern.sources.storage import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def digests(library, text):
    ids = encode(library, text)
    sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
    return (len(ids), *sha)


def test_round_trip(library, awkward):
    got = sorted((tuple(r) for r in bpe.round_trip(awkward, PATH).collect()), key=repr)
    assert got == sorted(((d, *digests(library, t)) for d, t in AWKWARD), key=repr)


def test_segments_of_long_texts(library, documents):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdeé日!1") for _ in range(3000)) + " tail <|endoftext|>x" + "q" * 500) for i in range(4)]
    got = sorted(tuple(r) for r in bpe.round_trip(documents(rows), PATH, long=400, segment=64).collect())
    assert got == [(d, *digests(library, t)) for d, t in rows]


def test_joins_agree_with_whole_encoding(library):
    rng, codec = random.Random(2), bpe.merges(PATH)
    for _ in range(60):
        text = "".join(rng.choice(rng.choice(["ab", "theandin", "éàß", "!?."])) for _ in range(rng.choice([200, 900])))
        assert codec.encode(text) == encode(library, text)


def test_files(spark, library, awkward):
    path = shared_dir(spark, "ids")
    token_files.write(awkward, path, PATH)
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in AWKWARD), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        at += r["n_tokens"]
    wanted = sorted(((d, [*encode(library, t), 1]) for d, t in AWKWARD), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in rows), key=repr) == wanted
    sums = token_files.round_trip(awkward, PATH).collect()
    crc = {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in sums}
    for d, ids in wanted:
        assert crc[d, len(ids)] == zlib.crc32(np.array(ids, "<u4").tobytes())
    chunk = pq.ParquetFile(glob.glob(path.removeprefix("file:") + "/*.parquet")[0]).metadata.row_group(0)
    columns = {chunk.column(i).path_in_schema: chunk.column(i) for i in range(chunk.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_empty_table(spark, awkward):
    none = awkward.where("false")
    assert token_files.round_trip(none, PATH).count() == 0 and bpe.round_trip(none, PATH).count() == 0


def test_some_documents_are_read_from_their_files_only(spark, documents, tmp_path):
    rows = [(i, f"document number {i} " * (i % 7)) for i in range(400)] + [(None, "without"), (5, "again")]
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(documents(rows), path, PATH)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    token_files.write_index(spark, path)
    whole = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids"]) for r in token_files.read(spark, path).collect()}
    for wanted in ([5], [0, 399], [17, 18, 250], [1_000], []):
        found = token_files.read_some(spark, path, wanted)
        got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids"]) for r in found.collect()}
        assert got == {k: v for k, v in whole.items() if k[0] in wanted}
    one = token_files.read_some(spark, path, [250])
    assert len(one.inputFiles()) == 1 < len(token_files.read(spark, path).inputFiles())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,250)" in plan.replace("In(doc_id, [250])", "EqualTo(doc_id,250)")


def test_plain_words_of_a_task_are_encoded_without_marks_between_them(monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    from lectern.llm.tokenizer import WordIds, loaded

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["the water supply", "", "été Water, WATER's 12 supply zzqxj é", "中文 the <|endoftext|> of  x\ty", "naïve!! a"]
    marked = []
    of_line = WordIds.of_line
    monkeypatch.setattr(WordIds, "of_line", lambda self, words: marked.extend(words) or of_line(self, words))
    words = WordIds(path)
    ids, counts = words.encode(pa.array(texts), 1)
    whole = [[*loaded(path).encode(text, add_special_tokens=False).ids, 1] for text in texts]
    assert [ids[a:b].tolist() for a, b in zip(counts, counts[1:])] == whole
    assert not {"the", "water", "supply", "été"} & set(marked)
    words.last = None  # a tokenizer whose tokens do not show where a piece ends
    assert words.of_others(["the", "mn"])[0].tolist() == words.of_line(["the"])["the"].tolist() + words.of_line(["mn"])["mn"].tolist()
    more, counts = words.encode(pa.array(["gathering the harvest"]))
    assert more.tolist() == loaded(path).encode("gathering the harvest", add_special_tokens=False).ids
