import pytest
from brute import clean

from tallyloom.llm import lookalikes as L

SCHEMA = "grp string, id long, text string"
CASES = [
    ("plain text, “quotes” – dashes … no", L.COMPATIBILITY),
    ("plain text, “quotes” – café naïve", 0),
    ("Ｆｕｌｌ width", L.COMPATIBILITY),
    ("ﬁne ligature", L.COMPATIBILITY),
    ("𝖼𝗈𝗉𝗂𝖾𝖽 letters", L.COMPATIBILITY),
    ("café apart", L.DECOMPOSED),
    ("tea​cup", L.INVISIBLE),
    ("so\xadft", L.INVISIBLE),
    ("no\xa0break and　wide", L.SPACE),
    ("ogham\u1680space", L.SPACE),
    ("уоur сode", L.LOOK),
    ("Τhe ο", L.LOOK),
    ("привет σπίτι друзья", 0),
    ("👩‍💻 🏳️‍🌈 ok", 0),
    ("a‍b", L.INVISIBLE),
    ("tab\tand\nline", 0),
    ("", 0),
]


def consistent(spark, texts):
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], SCHEMA)
    return {r.id: (r.text, r.variants) for r in L.consistent_form(df, id_col="id", text_col="text", group_col="grp").collect()}


def test_kinds(spark):
    got = consistent(spark, [c[0] for c in CASES])
    assert [(c[0], got[k][1]) for k, c in enumerate(CASES)] == CASES


def test_forms(spark):
    texts = ["уоur сode", "tea​cup", "Ｆｕｌｌ café", "no\xa0break", "привет", "👩‍💻", None, "", "уоur tеасuр"]
    got = consistent(spark, texts)
    assert [got[k][0] for k in range(len(texts))] == ["your code", "teacup", "Full café", "no break", "привет", "👩‍💻", None, "", "your teacup"]
    for k, t in enumerate(texts):
        if t and "💻" not in t:
            assert got[k][0] == clean(t)


def test_vocabulary_decides_what_a_letter_stands_for(spark):
    """The palochka is an l or an i; what the corpus spells is taken."""
    got = consistent(spark, ["fill the mill", "fӏll the mӏll", "fit", "fӏt", "Fӏt", "zӏz"])
    assert [got[k][0] for k in (1, 3, 4, 5)] == ["fill the mill", "fit", "Fit", "zlz"]


def test_trie_costs():
    root = L.trie([("cafe", 9), ("café", 1), ("cave", 2), ("fine", 1)])
    assert L.spelling(root, "саfе") == "cafe"
    assert L.spelling(root, "café") == "café"
    assert L.spelling(root, "ﬁne") == "fine"
    assert L.spelling(root, "c​ave") == "cave"
    assert L.spelling(root, "fíne") is None
    assert L.spelling(root, "fíne", most=1) == "fine"
    assert L.spelling({}, "x") is None


def test_weights_choose_between_accents(spark):
    """The cheapest spelling, an accent more or less at most; without one, the table."""
    root = L.trie([("cafe", 9), ("naïve", 3), ("resume", 4), ("résume", 9)])
    assert L.spelling(root, "naive", most=1) == "naïve"
    assert L.spelling(root, "naive") is None
    assert L.spelling(root, "résumé", most=1) == "résume"
    assert L.spelling(root, "résumé", most=2) == "résume"
    got = consistent(spark, ["a cafe, naïve words", "a сafé", "a nаive word", "а сréе"])
    assert [got[k][0] for k in range(4)] == ["a cafe, naïve words", "a cafe", "a naïve word", "a crée"]


@pytest.mark.parametrize("most", [L.MOST_FORMS, 0])
def test_rows_that_come_twice(spark, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_FORMS", most)
    data = [("g", 1, "сode"), ("g", 1, "сode"), ("g", 2, "plain"), ("g", 2, "plain")]
    got = L.consistent_form(spark.createDataFrame(data, SCHEMA), id_col="id", text_col="text", group_col="grp")
    assert sorted((r.id, r.text) for r in got.collect()) == [(1, "code"), (1, "code"), (2, "plain"), (2, "plain")]


def test_consistent_form_is_idempotent(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/train.parquet")
    once = L.consistent_form(df, id_col="src_pos", text_col="body")
    assert once.count() == df.count()
    again = L.consistent_form(once.select("id", "text"), id_col="id", text_col="text")
    assert again.where("variants <> 0").count() == 0
    assert once.where("variants <> 0").count() > 0


@pytest.mark.parametrize("texts", [[], [None]])
def test_nothing(spark, texts):
    assert consistent(spark, texts) == {k: (None, 0) for k in range(len(texts))}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("g", 1, "сode", "a", 3)], SCHEMA + ", word string, n int")
    assert L.consistent_form(df, id_col="id", text_col="text").first().text == "code"
