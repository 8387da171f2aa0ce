import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import patterns as P
from tallyloom.functions import text as N
from tallyloom.functions.text_exact import incremental, run_steps

GOLDEN = [
    ("urls", "From ftp://quay.northtide.org/a/b;c=2 or http://tideline.net, say", "From <URL> or <URL> say"),
    ("urls", "visit foo.com now", "visit <URL>now"),
    ("urls", "tell it. Me too", "tell <URL>too"),
    ("usernames", "hi u/bob and @al", "hi <USER> and <USER>"),
    ("usernames", "x@ab", "x@ab"),
    ("emails", "bob@x.de", "<EMAIL>"),
    ("subreddits", "see r/aww", "see <SUB>"),
    ("phones", "555-123-4567", "<PHONE>"),
    ("money", "$1,000", "<MONEY>"),
    ("money", "£50", "<MONEY>"),
    ("money", "€3.2M", "<MONEY>"),
    ("money", "$5 more", "<MONEY>ore"),
    ("random", "q7Rw2LmZ19#x", "<RANDOM>"),
    ("random", "covid19.", "<RANDOM>"),
    ("ips", "a 1.2.3.4 b", "a  b"),
    ("timestamps", "12:34, May 5, 2010 (UTC)", ""),
    ("timestamps", "12:34, 5 May 2010", "12:34, "),
    ("quotes", '"a "b" c"', 'a "b" c'),
    ("quotes", '"', ""),
    ("quotes", "  x\x1c ", "x"),
    ("characters", "sooooo", "soo"),
    ("characters", "1000!!!", "10!"),
    ("characters", "éé", "é"),
    ("words", "but but but", "but"),
    ("words", "the the theory", "the theory"),
    ("words", "a" + " word" * 5000, "a word"),
    ("whitespace", "a \t b\n\n", "a b\n\n"),
    ("text", "mail bob@x.com ok", "mail bob@<URL>ok"),
    ("incremental", "<URL_example.org> x", "<URL> x"),
    ("incremental", "<URL> <USER> foo <EMAIL>", "<URL> foo <USER>"),
    ("incremental", "a TOKENPLACEHOLDER b", "a TOKENPLACEHOLDER b"),
    ("incremental", "", ""),
    ("text", None, None),
    ("incremental", None, None),
]
HARD = [
    "", " ", "\n", "ſoſ kK K u/Ünï @a_b", "naïve  naïve naïve", "ÀÀÀ ßß", "x‍x @y‌", "éé é", "1.1.1.1.1", "the The tHe\nthe",
    "u/a u/b /u/c x/u/d", "call 1-800-FLOWERS-2 or +1 (555) 123.4567", "$$5 billion xx dollars Xx EUROS", "2010-01-02 03:04:05+00:00 5 May 2010 6 Jun 2011x",
    "a" * 3000 + ".com", "<USER> <USER> <URL>", "<RANDOM> aa1! TOKENPLACEHOLDER <EMAIL>", "(2nd 10:30am 3rd, a_1! [b2] c#3", "💥💥 💥 ok ok", "\x1d\x1cword\x1f word",
]


def native(name):
    if name == "text":
        return N.normalize_text
    if name == "incremental":
        return N.normalize_incremental
    return lambda c: N.apply_steps(c, P.STEPS[name])


def python(name, text):
    return incremental(text) if name == "incremental" else run_steps(text, P.ORDER if name == "text" else (name,))


@pytest.mark.parametrize("name", sorted({g[0] for g in GOLDEN}))
def test_golden(spark, name):
    cases = [g for g in GOLDEN if g[0] == name]
    df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(cases)], "k int, t string")
    got = [r.t for r in df.select("k", native(name)("t").alias("t")).orderBy("k").collect()]
    assert got == [c[2] for c in cases]
    assert [python(name, c[1]) for c in cases] == got


@pytest.mark.parametrize("name", [*P.STEPS, "text", "incremental"])
def test_native_equals_python(spark, sf, name):
    """On hard texts and on whole tables, the two backends agree."""
    bodies = pd.read_parquet(f"{sf}/train.parquet").body.tolist() + pd.read_parquet(f"{sf}/data3_positive.parquet").comment_text.tolist()
    texts = [None if not isinstance(x, str) else x for x in bodies] + HARD
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.t for r in df.select("k", native(name)("t").alias("t")).orderBy("k").collect()]
    want = [python(name, x) for x in texts]
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []


def test_loose_incremental_moves_nothing(spark):
    df = spark.createDataFrame([("<URL> <USER> foo  <EMAIL>",)], "t string")
    assert df.select(N.normalize_incremental("t", strict=False)).first()[0] == "<URL> <USER> foo <EMAIL>"


def test_incremental_never_grows(spark):
    df = spark.createDataFrame([("a1!",)], "t string")
    assert df.select(N.normalize_incremental("t")).first()[0] == "a1!"


def test_sanitized_and_na(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("NaN",), ("none",), (" a ",)], "t string")
    assert [r[0] for r in df.select(N.sanitized("t")).collect()] == [None, None, None, None, None, "a"]
    assert [r[0] for r in df.select(N.na_to_null("t")).collect()] == [None, None, " ", None, "none", " a "]


def test_columns_that_are_missing_stay_missing(spark):
    df = spark.createDataFrame([("a  b", 1)], "body string, text int")
    assert N.normalize_text_columns(df).collect()[0].asDict() == {"body": "a b", "text": 1}
    assert df.select(N.rule_label(F.lit("r" * 60))).first()[0] == "r" * 50 + "..."
