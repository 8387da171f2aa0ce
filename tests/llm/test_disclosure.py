import pandas as pd
import pytest

from tallyloom.llm import disclosure as D

SCHEMA = "grp string, id long, field string, text string"
NAMES = [("Mirelka", "given"), ("Tadeuso", "given"), ("Mark", "given"), ("Rose", "given"), ("Ashgrove", "family"), (None, "family"), ("Oak", None)]
# What the corpus teaches: shapes with cues, unlisted names with many given ones.
CORPUS = [f"Call 202-555-01{k:02d} after six." for k in range(12)] + [f"My SSN is 9{k:02d}-30-9717." for k in range(12)]
CORPUS += [f"Parcel 99{k % 10}-08-06{k:02d} never arrived." for k in range(30)] + [f"Build 10.94.{k:03d}.1149 fixed it." for k in range(20)]
CORPUS += ["Ask for Mirelka Ferrowgate.", "Signed, Tadeuso Ferrowgate.", "Rose Ferrowgate lives here.", "Mark my words.", "Thanks Rose that was kind."] * 2
CORPUS += ["my words that count", "that was my idea", "so that my mark"] * 8
CORPUS += ["Write to a.b@example.org please."] * 3 + ["I live at 5341 Kingfold Close now.", "Ship to 12 Kingfold Lane."] * 2


def details(spark, texts):
    data = [("t", k, "body", t) for k, t in enumerate([*texts, *CORPUS])]
    df = spark.createDataFrame(data, SCHEMA)
    found = D.personal_details(df, spark.createDataFrame(NAMES, "name string, name_kind string")).details
    return df, found, sorted((r.id, r.kind, r.start, r.stop) for r in found.collect() if r.id < len(texts))


CASES = [
    ("mail joe_1+x@post.example.org, ok", [("email", "joe_1+x@post.example.org")]),
    ("Contact: joe_1 (at) post [dot] example DOT org!", [("email", "joe_1 (at) post [dot] example DOT org")]),
    ("look at the dot on the map", []),
    ("Ring (202) 555-0143 now", [("phone", "(202) 555-0143")]),
    ("x 202-555-0177 y", [("phone", "202-555-0177")]),
    ("call +44 7700 900318.", [("phone", "+44 7700 900318")]),
    ("my SSN is 917-04-1017!", [("id_number", "917-04-1017")]),
    ("Parcel 917-04-1017 never arrived.", []),
    ("national insurance number QQ 95 72 09 C.", [("id_number", "QQ 95 72 09 C")]),
    ("passport no. is X08955851", [("id_number", "X08955851")]),
    ("Build 10.94.083.1149 fixed it.", []),
    ("I live at 77 Kingfold Lane, Apt 3, Port Emberly 00064 please", [("address", "77 Kingfold Lane, Apt 3, Port Emberly 00064")]),
    ("Flat 10, 81 Kingfold Close, Thornage in spring", [("address", "Flat 10, 81 Kingfold Close, Thornage")]),
    ("at 86 bis rue du Vieux Lavoir, Port Emberly before", [("address", "86 bis rue du Vieux Lavoir, Port Emberly")]),
    ("Party at Lanterner Str. 173, 00177 Caskton tonight", [("address", "Lanterner Str. 173, 00177 Caskton")]),
    ("Section 29 Street Rules and 12 Main Quest steps", []),
    ("Mr Mirelka Ashgrove never answered", [("name", "Mirelka Ashgrove")]),
    ("by TADEUSO K. ASHGROVE-FERROWGATE!", [("name", "TADEUSO K. ASHGROVE-FERROWGATE")]),
    ("Ask for Ferrowgate, Mirelka at the desk", [("name", "Ferrowgate, Mirelka")]),
    ("signed P. Ferrowgate", [("name", "P. Ferrowgate")]),
    ("Mark my words, Thanks Rose that was kind", []),
    ("u/mirelka and Mirelka alone", []),
    ("mіrеlka Аshgrovе and ｍａｉｌ a.b@ｅxample.org", [("name", "mіrеlka Аshgrovе"), ("email", "a.b@ｅxample.org")]),
    ("mi​relka Ash\xadgrove", [("name", "mi​relka Ash\xadgrove")]),
    ("Lost my wallet with SSN (917-04-1017) inside", [("id_number", "917-04-1017")]),
    ("Personal id: 917-04-1017. Call 202-555-0144 after six", [("id_number", "917-04-1017"), ("phone", "202-555-0144")]),
    ("My SSN no. is 917-04-1017. 202-555-0145 is my cell", [("id_number", "917-04-1017"), ("phone", "202-555-0145")]),
    ("((202) 555-0146) is my cell, my SSN is in the post", [("phone", "(202) 555-0146")]),
    ("Call 2 0 2 5 5 5 0 1 4 7 after six", [("phone", "2 0 2 5 5 5 0 1 4 7")]),
    ("Rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 of it", []),
]


def test_details(spark):
    texts = [c[0] for c in CASES]
    df, found, got = details(spark, texts)
    for k, (text, want) in enumerate(CASES):
        assert sorted((kind, text[a:b]) for i, kind, a, b in got if i == k) == sorted(want), text
    clean = {r.id: r.text for r in D.sanitised(df, found).collect()}
    for k, (text, want) in enumerate(CASES):
        for kind, part in want:
            text = text.replace(part, D.PLACEHOLDER[kind])
        assert clean[k] == text


def test_edges(spark):
    texts = [None, "", " ", "no details here", "word " * 50_000 + "mail a@b.example.org", "9" * 20_000, "a.b@example.org a.b@example.org"]
    df, found, got = details(spark, texts)
    assert [(i, kind) for i, kind, _, _ in got] == [(4, "email"), (6, "email"), (6, "email")]
    assert D.sanitised(df, found).where("id < 2").orderBy("id").collect()[0].text is None
    empty = df.where("false")
    names = spark.createDataFrame(NAMES, "name string, name_kind string")
    assert D.personal_details(empty, names).details.count() == 0
    assert D.personal_details(df, names.where("false")).details.where("kind = 'name'").count() == 0


def test_whole_texts_stay_but_for_the_details(spark, sf):
    from tallyloom.llm.queries import QUERIES

    root = sf.replace("sf0.001", "sf0.01")
    texts = {(r.tbl, r.src_pos, r.field): r.text for r in QUERIES["p2_sanitised"](spark, root).collect()}
    found = QUERIES["p2_found"](spark, root).toPandas()
    train = pd.read_parquet(f"{root}/train.parquet").set_index("src_pos")
    assert len(texts) == 2 * len(train) + len(pd.read_parquet(f"{root}/data3_positive.parquet"))
    changed = {(t, p, f) for t, p, f in zip(found.tbl, found.src_pos, found.field, strict=True)}
    for (t, p, f), text in texts.items():
        if t == "train" and (t, p, f) not in changed:
            assert text == train.at[p, f] or text is None


@pytest.mark.parametrize("text", ["ﬁ​ne", "plain", "é x", ""])
def test_places_in_the_stored_text(text):
    out, at = D.plain(text)
    assert len(out) == len(at)
    assert all(0 <= k < len(text) for k in at)


def test_what_reveals_little_stays(spark):
    """Forms of an e-mail address, a listed name and an address whose terms
    mostly stand elsewhere; beside them, each time, one whose terms don't."""
    crowd = [f"See news.example.com, issue {x}, or ask the mods {x}." for x in ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"] * 3]
    crowd += [f"The oak stands by the {x}, five minutes or a minute more." for x in ["pond", "gate", "mill", "road", "wall", "barn", "lake"] * 5]
    crowd = [f"{x} {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k, x in enumerate(crowd)]
    texts = [
        "Write to mods@news.example.com today", "Write to quillane@news.example.com today",
        "Mark Oak is here, Rose Ashgrove too", "A 5 minute drive, then 5341 Kingfold Drive",
    ]
    df = spark.createDataFrame([("t", k, "body", t) for k, t in enumerate([*texts, *crowd, *CORPUS])], SCHEMA)
    names = spark.createDataFrame([*NAMES, ("Oak", "family")], "name string, name_kind string")
    found = D.personal_details(df, names).details
    got = sorted((r.id, r.kind, texts[r.id][r.start : r.stop]) for r in found.collect() if r.id < len(texts))
    assert got == [(1, "email", "quillane@news.example.com"), (2, "name", "Rose Ashgrove"), (3, "address", "5341 Kingfold Drive")]


def test_copies_of_one_text_are_no_evidence(spark):
    texts = ["Meet me at 6214 kingfold rd. at noon"] * 300 + ["I live at 12 Kingfold Lane, Caskton now", "Ship to 7 Kingfold Court, Apt 3 please"]
    df = spark.createDataFrame([("t", k, "body", t) for k, t in enumerate(texts)], SCHEMA)
    found = D.personal_details(df, spark.createDataFrame(NAMES, "name string, name_kind string")).details
    assert found.where("kind = 'address'").count() == len(texts)
