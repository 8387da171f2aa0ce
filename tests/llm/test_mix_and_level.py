import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import reading_level as L
from tallyloom.llm import source_mix as M

TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_factor double"


def test_token_counts_round_trip(spark):
    import base64

    import tiktoken

    texts = ["Hello world!", "naïve 日本 <|endoftext|>", "", None, "x " * 1000]
    got = M.token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=M.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    for r in got.collect():
        ids = encoding.encode_ordinary(texts[r.id] or "")
        assert r.tokens == len(ids)
        assert encoding.decode(ids) == (texts[r.id] or "")


def test_pattern_is_the_public_one():
    public = pytest.importorskip("public_tokenizers")
    text = "It's 12  don't\n\n we'll   x1y\t\tz!? 'sd"
    import regex

    assert regex.findall(M.PRE_TOKENS, text) == regex.findall(public.PATTERN, text)


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 12)).alias("g"), "id", (F.col("id") % 5).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = M.running_totals(df, "g", ["id"], "v", "t").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = got.sort_values(["g", "id"])
    assert (got.groupby("g").v.cumsum() == got.running).all()
    assert len(got) == 2000


def mixed(spark, docs, targets):
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    got = M.mix_sources(docs, spark.createDataFrame(targets, TARGETS), id_col="doc_id", text_col="text", source_col="source")
    return got.items.toPandas(), got.shares.toPandas().set_index(["mix_name", "source"])


def test_shares_caps_and_odd_sources(spark):
    docs = [(k, "word " * (k % 7 + 1), " BIG " if k % 9 == 0 else "big", "x") for k in range(600)]
    docs += [(1000 + k, "word " * 5, "small", "x") for k in range(20)] + [(2000, None, "big", "x"), (2001, "word", None, "x"), (2002, "", "small", "x")]
    targets = [("m", "big", 0.5, 1, 0.5), ("m", "Small", 0.5, 3, 0.5), ("m", "absent", 0.2, 1, 0.5), ("n", "small", 1.0, 1, 0.01), ("n", "big", 0.0, 1, 0.01), ("o", "big", None, None, 0.1)]
    items, shares = mixed(spark, docs, targets)
    m = shares.loc["m"]
    longest = 9
    assert abs(m.actual_tokens["big"] - m.target_tokens["big"]) <= longest
    small = items[(items.mix_name == "m") & (items.source == "small")]
    # a source that is too small gives each document max_repeats times
    assert small.groupby("doc_id").size().eq(3).all()
    assert m.most_copies["small"] == 3
    assert (m.actual_tokens["absent"], m.n_items["absent"]) == (0, 0)
    assert abs(m.actual_share.sum() - 1) < 1e-9
    assert not items.duplicated(["mix_name", "doc_id", "copy_no"]).any()
    assert set(items.mix_name) == {"m", "n"}
    again, _ = mixed(spark, docs, targets)
    key = ["mix_name", "doc_id", "copy_no"]
    assert items.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_every_beginning_holds_the_shares(spark):
    docs = [(k, "word " * 4, "abc"[k % 3], "x") for k in range(900)]
    items, _ = mixed(spark, docs, [("m", "a", 0.5, 1, 0.5), ("m", "b", 0.3, 1, 0.5), ("m", "c", 0.2, 1, 0.5)])
    items = items.sort_values("finish_time")
    for n in (50, 150, 400):
        part = items.head(n).groupby("source").tokens.sum() / items.head(n).tokens.sum()
        assert abs(part["a"] - 0.5) < 0.03
        assert abs(part["c"] - 0.2) < 0.03


def test_nothing_to_mix(spark):
    items, shares = mixed(spark, [], [("m", "a", 0.5, 1, 0.5)])
    assert len(items) == 0
    assert shares.actual_share.tolist() == [0.0]


def test_isotonic():
    at, level = L.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 9.0]))
    assert level.tolist() == [1.0, 2.5, 9.0]
    assert at.tolist() == [1.0, 2.5, 4.0]


def test_features():
    easy = L.features("The cat sat. The dog ran. A pig hid.")
    hard = L.features("Notwithstanding institutional considerations, which generalise, longitudinal operationalisation problematises jurisprudence whenever participants internalise it.")
    assert len(easy) == len(L.FEATURES)
    assert hard[0] > easy[0]
    assert hard[2] > easy[2]
    assert L.features(None) is L.features("") is L.features(" 12 !") is None


def test_different_words_are_of_the_whole_text():
    place = L.FEATURES.index("different words")
    same = " ".join(["word"] * 400)
    varied = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"][:500]
    # the first 400 words are equal, what comes behind them isn't
    plain, rich = L.features(same + " word" * 500)[place], L.features(f"{same} {' '.join(varied)}")[place]
    assert rich > 10 * plain
    # every stretch by its length: 400, 400 and the last 100
    assert rich == pytest.approx((400 * 1 / 400**0.8 + 400 * 400 / 400**0.8 + 100 * 100 / 100**0.8) / 900)
    # a text that is longer, but no richer, gets the same
    text = " ".join(varied[:400])
    assert L.features(" ".join([text] * 5))[place] == pytest.approx(L.features(text)[place])
    # short texts: all different words by the power 0.8 of all words
    assert L.features("a b b c")[place] == pytest.approx(3 / 4**0.8)


def test_held_out_accuracy(spark, sf):
    """Grades that the ranker hasn't seen are met within about a year."""
    root = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/level_label.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    ranker = L.fit_ranker(docs, labels.where(seen), id_col="doc_id", text_col="text", grade_col="grade")
    got = L.reading_levels(docs, ranker, id_col="doc_id", text_col="text")
    assert got.count() == docs.count()
    both = got.join(labels.where(~seen).groupBy("doc_id").agg(F.avg("grade").alias("grade")), "doc_id").toPandas()
    assert (both.level - both.grade).abs().mean() < 1.5
    assert both.level.rank().corr(both.grade.rank()) > 0.7


def test_level_edges(spark):
    docs = spark.createDataFrame([(1, "The cat sat.", 1), (2, None, 1), (3, "", 1), (4, "Hard considerations notwithstanding generalisations. " * 3000, 1)], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(1, 2), (4, 12), (4, 14), (4, None), (9, 5)], "doc_id long, grade int")
    ranker = L.fit_ranker(docs, labels, id_col="doc_id", text_col="text", grade_col="grade")
    got = {r.doc_id: r.level for r in L.reading_levels(docs, ranker, id_col="doc_id", text_col="text").collect()}
    assert (got[2], got[3]) == (None, None)
    assert got[1] < got[4]
    with pytest.raises(ValueError, match="different grade"):
        L.fit_ranker(docs, labels.where("false"), id_col="doc_id", text_col="text", grade_col="grade")
    assert L.reading_levels(docs.where("false"), ranker, id_col="doc_id", text_col="text").count() == 0
