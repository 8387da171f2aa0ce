"""Every operator on nulls, very long texts, repeated rows and columns whose
names clash with those inside."""

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import disclosure, exact_copies, leaked_passages, lookalikes, near_copies, reading_level, source_mix, split_overlap

LONG = " ".join(f"Word{k % 997} tеxt{k % 31}" for k in range(60_000)) + " Mail joe.x@example.org. " + " ".join(f"more{k}" for k in range(40_000))
CLASHES = [
    "uid", "one", "two", "key", "part", "bits", "words", "pieces", "rare", "common", "head", "edge", "class_id", "copies", "variants", "skeleton", "word",
    "kind", "n", "label", "terms", "start", "stop", "running", "ranked", "queue", "place", "tokens", "supply", "level", "grade", "x", "held",
]


@pytest.fixture(scope="module")
def odd(spark):
    data = [("a", "body", 1, LONG), ("a", "body", 2, LONG.replace(" ", "  ")), ("a", "body", 3, None), ("a", "body", 4, ""), ("b", "body", 1, LONG), (None, "body", 5, "short"), ("a", None, None, LONG), ("a", "body", 1, LONG)]
    df = spark.createDataFrame(data, "grp string, field string, id long, text string").withColumn("source", F.lit("s"))
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


def test_copies(odd):
    got = exact_copies.formatting_copies(odd, id_col="id", text_col="text", group_col="grp")
    assert sorted(tuple(r) for r in got.copies.collect()) == [("a", 1, 2)]
    assert sorted(tuple(r) for r in got.collapsed().collect()) == [("", 5, 1), ("a", 1, 2), ("a", 3, 1), ("a", 4, 1), ("b", 1, 1)]


def test_near(odd):
    got = near_copies.near_copies(odd, id_col="id", text_col="text", group_col="grp").all_pairs()
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 2)]


def test_overlap(odd):
    got = split_overlap.split_overlap(odd.where("grp = 'b'"), odd.where("grp = 'a'")).rows()
    assert sorted((r.held_id, r.other_id, r.shared_chunks) for r in got.collect()) == [(1, 1, 1.0), (1, 2, 1.0)]


def test_forms(odd):
    got = {(r.grp, r.id): r for r in lookalikes.consistent_form(odd, id_col="id", text_col="text", group_col="grp").collect()}
    assert got["a", 1].text == LONG.replace("е", "e")
    assert got["a", 1].variants == lookalikes.LOOK
    assert (got["a", 3].text, got["a", 4].text, got["", 5].text) == (None, "", "short")


def test_details(spark, odd):
    names = spark.createDataFrame([("Ann", "given", 1)], "name string, name_kind string, term int")
    found = disclosure.personal_details(odd, names).details
    assert {(r.grp, r.id, r.kind, LONG.replace(" ", " " * (1 + (r.id == 2)))[r.start : r.stop]) for r in found.collect()} == {
        (g, i, "email", "joe.x@example.org") for g, i in (("a", 1), ("a", 2), ("b", 1))
    }
    assert disclosure.sanitised(odd.where("grp = 'b'"), found).first().text == LONG.replace("joe.x@example.org", "[EMAIL]")


def test_leaks(spark, odd):
    items = spark.createDataFrame([(7, " ".join(f"more{k}" for k in range(500, 700)), 1), (8, None, 2), (None, "x", 3)], "item long, passage string, doc_id int")
    got = leaked_passages.leaked_passages(odd, items, id_col="id", text_col="text", item_col="item", item_text_col="passage")
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in got.collect()) == [(1, 7, 200), (2, 7, 200)]


def test_mix(spark, odd):
    docs = odd.where("id is not null")  # id 1 comes three times, once in another group
    targets = spark.createDataFrame([("m", "S", 1.0, 1, 1.0, "z"), (None, "s", 1.0, 1, 1.0, "z"), ("m", None, 1.0, 1, 1.0, "z")], "mix_name string, source string, target_share double, max_repeats int, size_factor double, supply string")
    got = source_mix.mix_sources(docs, targets, id_col="id", text_col="text", source_col="source")
    assert sorted(r.doc_id for r in got.items.collect()) == [1, 2, 5]
    assert got.shares.first().actual_share == 1.0


def test_levels(spark, odd):
    labels = spark.createDataFrame([(1, 9, "t"), (5, 2, "t")], "id long, grade int, text string")
    docs = odd.where("id is not null")
    ranker = reading_level.fit_ranker(docs, labels, id_col="id", text_col="text", grade_col="grade")
    got = {r.id: r.level for r in reading_level.reading_levels(docs, ranker, id_col="id", text_col="text").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert reading_level.reading_levels(docs, ranker, id_col="id", text_col="text").count() == docs.count()
    assert (got[3], got[4]) == (None, None)
