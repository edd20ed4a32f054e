"""The stages of the pipeline, and the pipeline as a whole, against plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from conftest_llm import AWKWARD
from pyspark.sql import functions as F
from test_groups import LOWER, components, rows_with_copies
from tokenizers import Tokenizer

from lectern.llm import rows as rows_
from lectern.llm import toxicity

INSULT = "you are a vile gruntbag and nobody wants you here"


def documents_of():
    rows = AWKWARD + [(100 + d, t) for d, t in rows_with_copies(80, seed=6)]
    rows += [(700 + i, f"{INSULT} says number {i} " + "filler words of no note " * i) for i in range(40)]
    rows += [(800 + i, f"the weather of day {i} is fine and clear " + "filler words of no note " * i) for i in range(60)]
    return [(d, t, None, ("a", "b", None)[i % 3]) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("corpus"))
    documents(documents_of()).write.parquet(f"{made}/documents.parquet")
    marks = [(700 + i, 1, 1) for i in range(40)] + [(800 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (900, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def staged_again(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_and_whole(spark, folder, tmp_path):
    batches = spark.conf.get(corpus_pipeline.ROWS_OF_A_BATCH)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = listed(docs)
    first, second, third, fourth, fifth = (stage for _, stage in corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = Counter((r["doc_id"], r["predicted"]) for r in toxicity.scored(docs, labels).collect())
    kept = staged_again(spark, first(spark, docs, folder), f"{tmp_path}/1")
    assert kept.columns == docs.columns
    assert Counter(d for d, _ in listed(kept)) == Counter({d: n for (d, bad), n in scores.items() if not bad})
    assert not any(INSULT in (t or "") for _, t in listed(kept)) and len(listed(kept)) >= len(given) - 45

    unique = staged_again(spark, second(spark, kept, folder), f"{tmp_path}/2")
    best = {}
    for d, t in listed(kept):
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), -1 if d is None else d)
    assert Counter((-1 if d is None else d, (t or "").translate(LOWER)) for d, t in listed(unique)) == Counter(
        (d, key) for key, d in best.items()
    )

    apart = staged_again(spark, third(spark, unique, folder), f"{tmp_path}/3")
    found = components(listed(unique), 5, 80)
    wanted = Counter(c for _, n, c in found if n) + Counter(d for d, n, _ in found if not n)
    groups = {(c, n == 0, d if n == 0 else None) for d, n, c in found}
    left = listed(apart)
    assert len(left) <= sum(wanted.values()) and {d for d, _ in left} >= {c for c, empty, _ in groups if not empty}
    assert len(left) == len({c for d, n, c in found if n and c is not None}) + sum(n == 0 for _, n, _ in found) + sum(
        n > 0 and c is None for _, n, c in found
    )

    taken = staged_again(spark, fourth(spark, apart, folder), f"{tmp_path}/4")
    assert max(Counter(listed(taken)).values()) <= 2 * max(Counter(left).values()) and set(listed(taken)) <= set(left)

    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    wanted = Counter()
    for d, t in listed(taken):
        ids = library.encode(t or "", add_special_tokens=False).ids
        digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        wanted[d, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in digests)] += 1
    assert Counter(tuple(r) for r in fifth(spark, taken, folder).collect()) == wanted
    # The files of a stage are others when it runs again, the rows it returns are not.
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == wanted
    assert spark.conf.get(corpus_pipeline.ROWS_OF_A_BATCH) == batches


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_stay_are_not_shuffled(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        plan = stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, name
        docs = staged_again(spark, docs, f"{tmp_path}/{name}")


@pytest.mark.parametrize("sent", [1 << 14, 0])
def test_rows_by_number(spark, monkeypatch, tmp_path, sent):
    monkeypatch.setattr(rows_, "MAPS_SENT", sent)
    spark.range(100_000).repartition(3).selectExpr("id", "id as row", "'x' as _metadata").write.parquet(f"{tmp_path}/t")
    for df in (spark.read.parquet(f"{tmp_path}/t"), spark.range(70_000).withColumn("row", F.lit(1))):
        found = rows_.numbered(df)
        assert found.select("row").distinct().count() == df.count()
        gone = found.where("carried.id % 7 = 3").select("row")
        left = rows_.without(found, gone).select("carried.*")
        assert left.columns == df.columns and sorted(r["id"] for r in left.select("id").collect()) == [
            i for i in range(df.count()) if i % 7 != 3
        ]
        assert rows_.without(found, gone.where("false")).count() == df.count()
