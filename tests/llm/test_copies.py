import collections

import pytest
from brute import clean, words

from tallyloom.llm.exact_copies import formatting_copies

SCHEMA = "grp string, id long, text string"
BODY = "the quick brown fox jumps over the lazy dog by the river bank"


def copies(spark, data, **options):
    got = formatting_copies(spark.createDataFrame(data, SCHEMA), id_col="id", text_col="text", group_col="grp", **options)
    return sorted(tuple(r) for r in got.copies.collect()), sorted(tuple(r) for r in got.collapsed().collect())


def test_same_but_for_formatting(spark):
    data = [
        ("a", 5, BODY), ("a", 3, BODY.upper() + "!!"), ("a", 9, BODY.replace(" ", " \t\n")), ("a", 4, "Ｔｈｅ" + BODY[3:]), ("a", 1, BODY + " x"), ("b", 2, BODY),
        ("a", 10, "short"), ("a", 11, "short"), ("a", 12, None), ("a", 13, ""),
    ]
    found, collapsed = copies(spark, data)
    assert found == [("a", 3, 4), ("a", 3, 5), ("a", 3, 9)]
    assert collapsed == [("a", 1, 1), ("a", 3, 4), ("a", 10, 1), ("a", 11, 1), ("a", 12, 1), ("a", 13, 1), ("b", 2, 1)]


def test_labelled_records(spark):
    words_ = "one two three four five six seven eight nine ten"
    data = [
        ("a", 1, f"subreddit: r/x | title: {words_} | comment: hello there"),
        ("a", 2, f'{{"comment": "Hello, there", "title": "{words_.upper()}", "subreddit": "r/x"}}'),
        ("a", 3, f"**Title** = {words_}\n*COMMENT*: hello-there\nSubreddit: R/X"),
        ("a", 4, f"subreddit: r/x | flair: {words_} | comment: hello there"),
        ("a", 5, f"so subreddit: r/x | title: {words_} | comment: hello there"),
        ("a", 6, f"comment: hello there title {words_} subreddit: r/x"),
    ]
    found, _ = copies(spark, data)
    assert found == [("a", 1, 2), ("a", 1, 3)]


@pytest.mark.parametrize("size", [0, 1, 2, 7, 60])
def test_runs_over_many_partitions(spark, size):
    """A hot key that fills most partitions is still one group."""
    data = [("a" if k % 2 else "b", k, BODY) for k in range(size)] + [("a", 1000 + k, BODY + f" {k % 5}") for k in range(20)]
    data += data[:3]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found, collapsed = copies(spark, data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = collections.defaultdict(set)
    for g, i, t in data:
        groups[g, t].add(i)
    assert found == sorted((g, min(ids), i) for (g, _), ids in groups.items() for i in ids if i != min(ids))
    assert collapsed == sorted((g, min(ids), len(ids)) for (g, _), ids in groups.items())


def test_equals_brute_force(spark, sf):
    import pandas as pd

    train = pd.read_parquet(f"{sf.replace('sf0.001', 'sf0.01')}/train.parquet")
    data = [("t", int(i), t) for i, t in zip(train.src_pos, train.body, strict=True) if isinstance(t, str)]
    plain = [(g, i, t) for g, i, t in data if not words(t) or words(t)[0] not in ("subreddit", "title", "flair", "comment")]
    groups = collections.defaultdict(list)
    for _, i, t in plain:
        if len(words(t)) >= 12:
            groups["".join(words(t))].append(i)
    want = sorted(("t", min(ids), i) for ids in groups.values() for i in ids if i != min(ids))
    assert want
    assert copies(spark, plain)[0] == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, BODY, 7, "k"), ("a", 2, BODY, 8, "k")], SCHEMA + ", part int, key string")
    got = formatting_copies(df, id_col="id", text_col="text", group_col="grp")
    assert [tuple(r) for r in got.copies.collect()] == [("a", 1, 2)]
    assert clean("ok") == "ok"


@pytest.mark.parametrize("width", ["1", "7"])
def test_no_two_comments_of_one_text_remain(spark, sf, width):
    """Counts over whole tables equal those of the keys, across partitions."""
    from collections import Counter

    import pandas as pd

    from tallyloom.llm.exact_copies import LABELS, _label_pattern, canonical_key
    from tallyloom.llm.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = QUERIES["p1_collapsed"](spark, sf).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, first = Counter(), {}
    for tbl, column in (("train", "body"), ("data3_positive", "comment_text")):
        for k, text in pd.read_parquet(f"{sf}/{tbl}.parquet").set_index("src_pos")[column].sort_index().items():
            key = (tbl, k) if text is None else (tbl, canonical_key(text, _label_pattern(LABELS), 0))
            want[key] += 1
            first.setdefault(key, (tbl, k))
    assert sorted(zip(got.tbl, got.src_pos, got.copies, strict=True)) == sorted((*first[k], n) for k, n in want.items())
    assert got.copies.max() > 1


def test_short_and_wordless_texts(spark):
    data = [("a", 1, "ok"), ("a", 2, "OK!"), ("a", 3, "!!!"), ("a", 4, "! !!"), ("a", 5, "???"), ("a", 6, ""), ("a", 7, " \n"), ("a", 8, None), ("a", 9, None), ("a", 2, "OK!")]
    got = formatting_copies(spark.createDataFrame(data, "grp string, id long, text string"), id_col="id", text_col="text", group_col="grp", min_words=0)
    assert sorted(tuple(r)[1:] for r in got.collapsed().collect()) == [(1, 2), (3, 2), (5, 1), (6, 2), (8, 1), (9, 1)]
