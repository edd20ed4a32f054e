import pytest

from lectern.operators import catalogue

BOOK = "idx int, id int, title string, image string, author string, active boolean"


@pytest.fixture(scope="module")
def shelf(spark):
    books = spark.createDataFrame(
        [(1, 10, "Deep 100% Water", "a.jpg", "Ann Bee", True), (3, 20, "deep_sea", "", "Cy", True), (5, 30, "Sky", "c", "Ann", False)],
        BOOK,
    )
    tags = spark.createDataFrame([(1, "Sea"), (2, "Air"), (3, "None")], "id int, name string")
    bridge = spark.createDataFrame([(10, 1), (20, 1), (20, 2), (30, 2), (40, 2)], "book_id int, tag_id int")
    return books, bridge, tags


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search(shelf):
    books, bridge, tags = shelf
    assert ids(catalogue.search(books, "DEEP", "title")) == [10, 20]
    assert ids(catalogue.search(books, "%", "title")) == [10]
    assert ids(catalogue.search(books, "_", "title")) == [20]
    assert ids(catalogue.search(books, " ann ", "author")) == [10, 30]
    assert ids(catalogue.search(books, "ea", "tags", tags, bridge)) == [10, 20]
    assert ids(catalogue.search(books, "  ", "title")) == ids(catalogue.search(books, "x", "")) == [10, 20, 30]


def test_shapes(shelf):
    books, bridge, tags = shelf
    listed = {r["id"]: r["tags"] for r in catalogue.books_with_tags(books, bridge, tags).collect()}
    assert listed == {10: ["Sea"], 20: ["Air", "Sea"], 30: ["Air"]}
    bare = catalogue.books_with_tags(books, bridge.limit(0), tags).collect()
    assert [r["tags"] for r in bare] == [[], [], []]
    nested = {(r["name"], r["page"]): [b["id"] for b in r["books"]] for r in catalogue.tags_with_books(tags, bridge, books, 15).collect()}
    assert nested == {("Sea", 0): [10], ("Sea", 1): [20], ("Air", 1): [20], ("Air", 2): [30], ("None", 0): []}
    assert ids(catalogue.tags_of(20, bridge, tags)) == [1, 2]
    assert ids(catalogue.books_of(2, bridge, books)) == [20, 30]


def test_detail(shelf):
    books, bridge, tags = shelf
    found = catalogue.book_detail(books, bridge, tags, 20).first()
    assert found["tags"] == ["Air", "Sea"] and found["image"] == "/media/calibre-library-image/"
    assert catalogue.book_detail(books, bridge, tags, 99).count() == 0
    assert [r["image"] for r in catalogue.book_cards(books).orderBy("id").collect()][1] is None


def test_soft_diff(spark, shelf):
    target, _, _ = shelf
    source = spark.createDataFrame(
        [(0, 10, "changed", "x", "x", True), (0, 30, "back", "x", "x", True), (0, 7, "n7", "x", "x", True), (0, 5, "n5", "x", "x", True)],
        BOOK,
    )
    found = {r["id"]: r for r in catalogue.apply_diff(target, source, ["id"], "soft").collect()}
    assert sorted(found) == [5, 7, 10, 20, 30]
    assert found[10]["title"] == "Deep 100% Water" and found[10]["active"]
    assert not found[20]["active"]          # gone from the source
    assert not found[30]["active"]          # came back, stays inactive
    assert (found[5]["idx"], found[7]["idx"]) == (6, 7) and found[5]["active"]


def test_hard_diff_and_keys(spark):
    source = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "book_id int, tag_id int")
    target = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "book_id int, tag_id int")
    keys = ["book_id", "tag_id"]
    changes = sorted(tuple(r) for r in catalogue.diff_keys(source, target, keys).collect())
    assert changes == [(1, 2, "new"), (2, 2, "deleted")]
    merged = catalogue.apply_diff(target, source.distinct(), keys, "hard")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 1), (1, 2)]
    with pytest.raises(ValueError):
        catalogue.apply_diff(target, source, keys, "other")


def test_extract_leaves_out_books_without_author(spark):
    source = {
        "books": spark.createDataFrame(
            [(1, "A", 0, 0, "Ann/It's"), (2, "B", 0, 0, "p")], "id int, title string, timestamp long, pubdate long, path string"
        ),
        "authors": spark.createDataFrame([(1, "Zed"), (2, "Amy")], "id int, name string"),
        "books_authors_link": spark.createDataFrame([(1, 1), (1, 2)], "book int, author int"),
        "tags": spark.createDataFrame([(1, "t")], "id int, name string"),
        "books_tags_link": spark.createDataFrame([(1, 1)], "book int, tag int"),
    }
    books, tags, pairs = catalogue.extract_catalogue(source)
    row = books.collect()
    assert len(row) == 1 and row[0]["author"] == "Amy, Zed"
    assert row[0]["image"] == "Ann/It_s/cover.jpg" and row[0]["sidecar"] == "Ann/It's/metadata.opf"
    assert catalogue.deleted_keys(books, source["books"], ["id"]).first()["id"] == 2
    assert tags.count() == pairs.count() == 1


def test_transform_only_new(spark):
    source = spark.createDataFrame([(1, "old", "s"), (2, "new", "s"), (3, "bare", "s")], "id int, title string, summary string")
    target = spark.createDataFrame([(1,)], "id int")
    descriptions = spark.createDataFrame([(1, "x"), (2, "<p>a  b</p>")], "id int, description string")
    found = {r["id"]: r for r in catalogue.transform_new(source, target, descriptions).collect()}
    assert {i: r["summary"] for i, r in found.items()} == {2: "a b", 3: "NaN"}
    assert len(found[2]["title_embed"]) == len(found[2]["summary_embed"]) == 768


def test_recommended_books_keep_rank(spark, shelf):
    books, _, _ = shelf
    recs = spark.createDataFrame([(1, 1, 30), (1, 2, 99), (1, 3, 10)], "uid int, rank int, bid int")
    found = catalogue.recommended_books(recs, books).orderBy("rank").collect()
    assert [(r["rank"], r["bid"]) for r in found] == [(1, 30), (3, 10)]
