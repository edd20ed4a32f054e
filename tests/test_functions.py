import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import actions, text, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a<b\nc>d", "a<b\nc>d"),
        ("a<b\rc>d", "ad"),
        ("<p>one</p><br/>two", "onetwo"),
        ("<a <b> c>", " c>"),
    ],
)
def test_strip_tags(spark, raw, clean):
    assert one(spark, raw, text.strip_tags) == clean


def test_squeeze_knows_unicode_spaces(spark):
    raw = "  a  \tb\x1c\x1fc　\x85"
    assert one(spark, raw, text.squeeze) == " ".join(raw.split()) == "a b c"


def test_clean_description_of_nothing(spark):
    assert one(spark, None, text.clean_description) == "NaN"


@pytest.mark.parametrize("raw", ["", "  ", "Der  Über Mut\n", "x x", "\x1d\x1ea"])
def test_tokens_are_those_of_python(spark, raw):
    assert one(spark, raw, text.tokens) == raw.lower().split()


def test_summary_labels(spark):
    assert one(spark, "NaN", text.no_summary) == "No summary available"
    assert one(spark, "NaN", lambda c: text.no_summary(c, "No summary available.")) == "No summary available."
    assert one(spark, "x", text.no_summary) == "x"


def test_doc_text_without_parts(spark):
    assert one(spark, None, lambda c: text.doc_text(c, c)) == " "


@pytest.mark.parametrize(
    "xml, description",
    [
        ("<package xmlns:dc='u'><metadata><dc:description>a &lt;b&gt; c</dc:description></metadata></package>", "a <b> c"),
        ("<package xmlns:dc='u'><metadata><dc:title>t</dc:title></metadata></package>", None),
        ("<package><metadata>", "NaN"),
        ("not xml", "NaN"),
        (None, "NaN"),
    ],
)
def test_xml_description(spark, xml, description):
    assert one(spark, xml, text.xml_description) == description


def test_media_url(spark):
    assert one(spark, "a.jpg", text.media_url) == "/media/calibre-library-image/a.jpg"
    assert one(spark, "", text.media_url) is None


def test_rewards(spark):
    rows = spark.createDataFrame([("click",), ("skip",), ("read",), ("signup",), (None,)], "a string")
    found = rows.select(actions.reward(F.col("a")).alias("r"), actions.known_reward(F.col("a")).alias("k")).collect()
    assert [row["r"] for row in found] == [1, -1, 2, 0, 0]
    assert [row["k"] for row in found] == [1, -1, 2, None, None]
    kinds = spark.createDataFrame([(1,), (2,), (-1,), (0,)], "r int").select(actions.reward_index(F.col("r")).alias("i"))
    assert [row["i"] for row in kinds.collect()] == [1, 2, 0, 0]


def test_epoch_date_is_utc(spark):
    assert one(spark, 1705363199, actions.epoch_date, "long") == dt.date(2024, 1, 15)
    assert one(spark, -1, actions.epoch_date, "long") == dt.date(1969, 12, 31)


def test_month_label(spark):
    row = spark.createDataFrame([(2024, 3)], "y int, m int")
    assert row.select(actions.month_label(F.col("y"), F.col("m")).alias("l")).first()["l"] == "2024-03"


def test_distances(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    a, b = F.col("a"), F.col("b")
    found = rows.select(vectors.cosine_distance(a, b).alias("c"), vectors.l2(a, b).alias("l")).collect()
    assert found[0]["c"] == 1.0 and found[0]["l"] == pytest.approx(math.sqrt(5))
    assert found[1]["c"] == pytest.approx(0.0, abs=1e-12)
    assert math.isnan(found[2]["c"])
    assert found[3]["c"] is None and found[3]["l"] is None


# A published example of title and summary distances with their weighted sum.
GOLDEN = [
    (0.3298757076263428, 0.380096353286721, 0.4500101187782121),
    (0.4204956889152527, 0.41564927743820157, 0.5219848025362775),
    (0.33089373501818553, 0.44481372833251953, 0.4990571637584824),
    (0.44250903852310863, 0.399073374381851, 0.5205595500479425),
    (0.4790986465870518, 0.5046560764312744, 0.6180413806169818),
]


def test_weighted_distance(spark):
    rows = spark.createDataFrame(GOLDEN, "t double, s double, c double")
    found = rows.select(vectors.combined(F.col("t"), F.col("s")).alias("mine"), "c").collect()
    assert [row["mine"] for row in found] == [row["c"] for row in found]


def test_vector_text_round_trip(spark):
    assert one(spark, "[0.5, -1.25]", vectors.parse_vector) == [0.5, -1.25]
    assert one(spark, [0.5, -1.25], vectors.to_json_vector, "array<float>") == "[0.5,-1.25]"


def test_vectors_are_handed_on_some_texts_at_a_time():
    import numpy as np
    import pyarrow as pa

    from lectern.operators import embedding

    lists = [[n, -n, 1 << 33] for n in range(600)] + [[]]
    found = list(embedding.added_up(iter([pa.array(lists, pa.list_(pa.int64()))]), 8))
    assert [len(part) for part in found] == [256, 256, 89]
    vectors = [v for part in found for v in part.to_pylist()]
    for own, vector in zip(lists, vectors):
        want = np.zeros(8)
        for h in own:
            want[h % 8] += -1 if (h >> 32) & 1 else 1
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1))
