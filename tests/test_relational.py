import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import pools as P
from tallyloom.operators import splits as R
from tallyloom.operators.ordering import global_rank, running_total
from tallyloom.sources import sinks
from tallyloom.sources import tables as T

TRAIN = "src_pos long, row_id long, body string, rule string, positive_example_1 string, positive_example_2 string, negative_example_1 string, negative_example_2 string, rule_violation int"
TOXIC = "src_pos long, comment_text string, severe_toxicity double, obscene double, threat double, insult double"


def toxic(spark, *parts):
    """Four tables of (src_pos, text, obscene, insult)."""
    make = lambda data: spark.createDataFrame([(p, t, None, o, None, i) for p, t, o, i in data], TOXIC).withColumns(
        {c: F.lit(None).cast("double") for c in ("identity_hate", "identity_attack", "sexual_explicit")}
    )
    return R.toxicity_union(*(make(p) for p in parts))


def test_global_rank_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise("b").alias("g"), "id")
    got = global_rank(df, ["g"], [F.md5(F.col("id").cast("string"))]).collect()
    for g in ("hot", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert {r.pos_of for r in mine} == {len(mine)}
    assert rows(global_rank(df.where("false"), ["g"], ["id"])) == []


def test_running_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    assert all(r.s == sum(x % 7 for x in range(r.id)) for r in running_total(df, ["id"], "v", "s").collect())


def test_keep_first_and_precedence(spark):
    union = toxic(
        spark,
        [(5, "x", 0.1, 0.0), (0, "x", 0.9, 0.0), (1, None, 0.5, 0.0), (2, "both", 0.5, 0.5)],
        [(0, "x", 0.0, 0.0), (1, "third", 0.0, 0.0)],
        [(0, None, 0.5, 0.0), (1, "both", 0.5, 0.0)],
        [(0, "third", 0.0, 0.0)],
    )
    once = R.keep_first(union, ["dataset", "polarity", "comment_text"], "src_pos")
    assert [(r.src_pos, r.obscene) for r in once.where("dataset = 2 and comment_text = 'x' and polarity = 'positives'").collect()] == [(0, 0.9)]
    clean = R.clean_toxicity(union).where("dataset = 2")
    assert rows(clean.select("polarity", "comment_text")) == [("negatives", "x"), ("positives", "x")]


@pytest.mark.parametrize(("n", "train"), [(0, 0), (1, 0), (3, 2), (10, 7), (29, 20), (30, 21)])
def test_split_sizes(spark, n, train):
    df = spark.range(n).select(F.lit(1).alias("g"), F.concat(F.lit("t"), "id").alias("text"))
    got = R.split_by_hash(df, ["g"], "text")
    assert got.where("split = 'train'").count() == train
    assert got.count() == n
    again = R.split_by_hash(df.repartition(7), ["g"], "text")
    assert rows(got) == rows(again)


def test_halves(spark):
    got = R.halves(spark.range(5), "id").groupBy("worker").count()
    assert rows(got) == [(0, 2), (1, 3)]


def train(spark, *data):
    return spark.createDataFrame(data, TRAIN)


def test_group_by_rule(spark):
    df = train(
        spark,
        (0, 1, "b0", "R", "p1", "p2", "n1", None, 1),
        (1, 2, "b1", " R", "q", "p1", "n1", "n2", 0),
        (2, 3, "b2", "R", "p2", "p1", None, "n2", None),
        (3, 4, "b3", None, "z", "z", "z", "z", 1),
        (4, 5, "b4", "S", "p1", "p1", "p1", "n1", 2),
    )
    last = P.group_by_rule(df, include_body=True)
    # " R" was seen first after "R": it replaces it
    assert rows(last.where("rule = 'R'")) == [("R", "negatives", 0, "n1"), ("R", "negatives", 1, "n2"), ("R", "negatives", 2, "b1"), ("R", "positives", 0, "q"), ("R", "positives", 1, "p1")]
    merged = P.group_by_rule(df, include_body=True, collision="merge")
    assert [r.text for r in merged.where("rule = 'R' and polarity = 'positives'").orderBy("pos").collect()] == ["p1", "q", "p2", "b0"]
    assert [r.text for r in merged.where("rule = 'R' and polarity = 'negatives'").orderBy("pos").collect()] == ["n1", None, "n2", "b1"]
    nested = P.nested(merged).where("rule = 'S'").first()
    assert (nested.positives, nested.negatives) == (["p1"], ["p1", "n1"])
    assert rows(P.group_by_rule(df.where("false"))) == []


def test_threshold_and_fan_out(spark):
    nan = float("nan")
    union = toxic(
        spark,
        [(0, "at", 0.33, 0.9), (1, "below", 0.3299, None), (2, "nan", nan, nan)],
        [(0, "n2", 0.0, 0.0)],
        [(0, "third", 0.5, 0.0)],
        [(0, "n3", 0.0, 0.0), (1, None, 0.0, 0.0)],
    )
    defs = spark.createDataFrame([("obscene", "no filth"), ("insult", "be kind"), ("threat", "no threats"), ("other", "unknown")], "rule_key string, rule string")
    pools = P.fan_out(union, defs)
    long = pools.long()
    assert rows(long.where("polarity = 'positives'")) == [("insult", "be kind", "positives", 0, "at"), ("obscene", "no filth", "positives", 0, "at"), ("obscene", "no filth", "positives", 1, "third")]
    assert rows(long.where("rule_key = 'threat'").select("pos", "text")) == [(0, "n2"), (1, "n3"), (2, None)]
    assert pools.items.where("pool_id = 'shared/negatives'").count() == 3


def pool(spark, *data):
    return spark.createDataFrame([(*x[:2], k, x[2]) for k, x in enumerate(data)], "rule string, polarity string, pos long, text string")


@pytest.mark.parametrize(
    ("data", "fully", "partially", "unique"),
    [
        ([], True, True, 0),
        ([("a", "negatives", "x")], True, True, 1),
        ([("a", "negatives", "x"), ("b", "negatives", "x")], True, True, 1),
        ([("a", "negatives", "x"), ("b", "negatives", "x"), ("b", "negatives", "y")], False, True, 2),
        ([("a", "negatives", "x"), ("b", "negatives", "y")], False, False, 2),
        ([("a", "negatives", "x"), ("b", "positives", "y")], False, False, 1),
    ],
)
def test_negatives_report(spark, data, fully, partially, unique):
    got = P.negatives_report(pool(spark, *data)).first()
    assert (got.fully_shared, got.partially_shared, got.total_unique) == (fully, partially, unique)


def test_own_negatives(spark):
    refs = [("a", "negatives", "x"), ("b", "negatives", "y"), ("a", "positives", "z")]
    frame = lambda data: spark.createDataFrame(data, "rule string, polarity string, pool_id string")
    assert rows(P.own_negatives(frame(refs))) == sorted(refs)
    with pytest.raises(Exception, match="shared"):
        P.own_negatives(frame([*refs, ("c", "negatives", "x")])).collect()


def test_split_pools_keeps_sides_apart(spark):
    data = [("a", "positives", f"p{k}") for k in range(10)] + [(r, "negatives", f"n{k}") for r in "ab" for k in range(10)] + [(r, "negatives", x) for r in "ab" for x in ("", None)]
    got = P.split_pools(pool(spark, *data))
    assert rows(got.groupBy("split", "rule", "polarity").count()) == [
        ("holdout", "*", "negatives", 3), ("holdout", "a", "positives", 3), ("train", "*", "negatives", 7), ("train", "a", "positives", 7),
    ]
    own = P.split_pools(pool(spark, *data), shared=False)
    assert own.where("rule = 'b'").count() == 12


def test_combine_right_wins(spark):
    one, two = pool(spark, ("a", "positives", "x"), ("b", "positives", "x")), pool(spark, ("b", "positives", "y"))
    assert rows(P.combine(one, two).select("rule", "text")) == [("a", "x"), ("b", "y")]


def test_pools_on_disk(spark, tmp_path):
    pools = pool(spark, ("a", "positives", "x")).withColumn("split", F.lit("train"))
    sinks.save_pools(pools, str(tmp_path / "p"))
    assert sinks.load_pools(spark, str(tmp_path / "p"), "train").count() == 1
    sinks.save_pools(pools.where("false"), str(tmp_path / "empty"))


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('comment_text,obscene,extra\n"two\nlines, ""quoted""",0.5,1\nNA,x,2\n,,3\n')
    from tallyloom import schemas

    schema = [f for f in schemas.DATA2 if f.name in ("comment_text", "obscene")]
    got = T.read_csv(spark, str(tmp_path / "t.csv"), type(schemas.DATA2)(schema)).orderBy("src_pos")
    assert [(r.comment_text, r.obscene) for r in got.collect()] == [('two\nlines, "quoted"', 0.5), (None, None), (None, None)]
    text = spark.createDataFrame([(1, '  "a"\n\tb ', "r")], "row_id long, body string, rule string")
    sinks.save_csv(text, str(tmp_path / "out"))
    back = T.read_csv(spark, str(tmp_path / "out"), text.schema)
    assert back.first().body == '  "a"\n\tb '


def test_cleaning(spark):
    comments = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    labels = spark.createDataFrame([(1, 0), (2, -1)], "id int, toxic int")
    assert rows(T.attach_labels(comments, labels, "id", "toxic")) == [(1, "a", 0)]
    scores = spark.createDataFrame([(0.1, 0.6), (None, 0.2), (None, None)], "toxic double, severe double")
    assert rows(T.fold_scores(scores, "severe", "toxic", "severe")) == [(None,), (0.2,), (0.6,)]
    sided = T.by_polarity(spark.createDataFrame([(0.0, None), (float("nan"), 0.5), (float("nan"), None)], "a double, b double"), ("a", "b"))
    assert sorted(r.polarity for r in sided.collect()) == ["negatives", "negatives", "positives"]
    assert T.toxicity_paths("D")[0].startswith("D")


def test_csv_order_is_that_of_the_files(spark, tmp_path):
    """Spark packs files into tasks by size; the order is by path all the same."""
    from pyspark.sql import types as T

    from tallyloom.sources.tables import read_csv

    sizes = [3, 400, 1, 250, 2, 90]
    for k, n in enumerate(sizes):
        rows = "".join(f'"text {k}\nline ""{j}"""\n' for j in range(n))
        (tmp_path / f"part {k}.csv").write_text("body\n" + rows)
    got = read_csv(spark, str(tmp_path), T.StructType([T.StructField("body", T.StringType())])).orderBy("src_pos").collect()
    assert [r.body for r in got] == [f'text {k}\nline "{j}"' for k, n in enumerate(sizes) for j in range(n)]
    assert len({r.src_pos for r in got}) == sum(sizes)


def test_scope_removes_its_tables(spark, tmp_path, monkeypatch):
    import os

    from tallyloom import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
    files = lambda: sum(len(f) for _, _, f in os.walk(tmp_path))
    with storage.scope(spark):
        assert storage.materialise(spark.range(5), "x").count() == 5
        assert files() > 0
    assert files() == 0


@pytest.mark.parametrize("by_class", [False, True])
def test_head_from_a_matrix(spark, tmp_path, by_class):
    import numpy as np

    from tallyloom.sources.tables import read_head

    matrix = np.arange(6, dtype=np.float32).reshape((2, 3) if by_class else (3, 2))
    np.save(tmp_path / "head.npy", matrix)
    got = {r.class_id: list(r.w) for r in read_head(spark, str(tmp_path / "head.npy"), by_class=by_class).collect()}
    assert got == {k: list(w) for k, w in enumerate(matrix if by_class else matrix.T)}
    np.save(tmp_path / "flat.npy", np.arange(6))
    with pytest.raises(ValueError, match="dimensions"):
        read_head(spark, str(tmp_path / "flat.npy"))


@pytest.mark.parametrize("most", [10**6, 0])
def test_remap_either_way(spark, most):
    from tallyloom.operators import tokens as V

    df = spark.createDataFrame([(1, [5, 7, 9, None]), (2, []), (3, None)], "k int, ids array<int>")
    vocab = spark.createDataFrame([(5, 0), (9, 1)], "old_id int, new_id long")
    assert {r.k: r.ids for r in V.remap(df, vocab, ["k"], most=most).collect()} == {1: [0, 2, 1, 2], 2: [], 3: None}


def test_byte_ids(spark):
    from tallyloom.operators import tokens as V

    texts = ["plain", "é​😀", "", None, "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2)
    got = {r.k: r.ids for r in df.select("k", V.ByteTokenizer().ids(df.t).alias("ids")).collect()}
    assert got == {k: None if t is None else list(t.encode()) for k, t in enumerate(texts)}


def test_public_tokens_are_the_text_again(spark, sf):
    import base64

    from tallyloom.operators import tokens as V

    with open(V.BYTE_BPE, "rb") as f:
        words = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f.read().splitlines() if x)}
    df = spark.read.parquet(f"{sf}/train.parquet").where("body is not null")
    for r in df.select("body", V.PublicTokenizer(V.BYTE_BPE, V.BYTE_BPE_PATTERN).ids(df.body).alias("ids")).limit(200).collect():
        assert b"".join(words[x] for x in r.ids).decode() == r.body


def test_null_and_empty_negatives_are_two(spark):
    from tallyloom.operators import pools as P

    data = [("r", "negatives", 0, None), ("r", "negatives", 1, ""), ("r", "negatives", 2, "x"), ("r", "positives", 0, "y")]
    assert P.unique_negatives(spark.createDataFrame(data, "rule string, polarity string, pos int, text string")).first().unique_count == 3
