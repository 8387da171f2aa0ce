import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import prompts as E
from tallyloom.operators import scoring as S
from tallyloom.operators import tokens as V
from tallyloom.plans import pipelines

POOLS = "rule string, polarity string, pos long, text string"


def pools(spark):
    data = [("r", "positives", k, f"p{k}") for k in range(3)] + [("r", "negatives", k, f"n{k}") for k in range(2)]
    return spark.createDataFrame(data, POOLS)


def test_cyclic_sampler(spark):
    df = spark.createDataFrame([(k, 10 + k, "r " if k % 2 else "r", f"b{k}") for k in range(5)], "src_pos long, row_id long, rule string, body string")
    got = E.sample_support(E.expand(df), pools(spark), order=["src_pos", "variant"])
    pick = lambda p: [r.support_pos for r in got.where(F.col("polarity") == p).orderBy("src_pos").collect()]
    assert pick("positives") == [0, 1, 2, 0, 1]
    assert pick("negatives") == [0, 1, 0, 1, 0]


def test_reshuffled_rounds_use_every_item_once(spark):
    df = spark.createDataFrame([(k, "r", "positives") for k in range(9)], "src_pos long, rule string, polarity string")
    got = E.sample_support(df, pools(spark), order=["src_pos"], seed=1).orderBy("draw").collect()
    for k in range(3):
        assert sorted(r.support_pos for r in got[3 * k : 3 * k + 3]) == [0, 1, 2]


def test_missing_pool(spark):
    df = spark.createDataFrame([(0, "none", "positives"), (1, None, "positives")], "src_pos long, rule string, polarity string")
    assert [r.support for r in E.sample_support(df, pools(spark), order=["src_pos"]).collect()] == [None, None]
    with pytest.raises(Exception, match="no pool"):
        E.sample_support(df, pools(spark), order=["src_pos"], on_missing="error").collect()


@pytest.mark.parametrize("tokenizer", [V.ByteTokenizer(), V.WordTokenizer()])
def test_prompt_and_positions(spark, tokenizer):
    df = spark.createDataFrame([(7, 0, "r", "target é")], "row_id long, src_pos long, rule string, body string")
    got = E.sample_support(E.expand(df), pools(spark), order=["src_pos", "variant"])
    ids, places = E.prompt_ids(tokenizer, "rule", "support", "support_label", "body"), E.answer_positions(tokenizer, "rule", "support", "support_label", "body")
    got = got.select("polarity", E.prompt_text("rule", "support", "support_label", "body").alias("prompt"), ids.alias("ids"), places.alias("places")).collect()
    for r in got:
        answer = "Yes" if r.polarity == "positives" else "No"
        assert r.prompt == f"{E.HEADER}Rule: r\nComment: {'p0' if answer == 'Yes' else 'n0'}\nViolation: {answer}\nComment: target é\nViolation:"
        assert r.places[1] == len(r.ids) - 1
        if isinstance(tokenizer, V.ByteTokenizer):
            assert bytes(r.ids).decode() == r.prompt
            assert r.prompt.encode()[: r.places[0] + 1].decode().endswith("Violation:")


def test_training_samples(spark):
    variants = spark.createDataFrame([("r", 0, "one way"), ("r", 1, "another")], "rule string, variant_no int, text string")
    got = E.training_samples(spark, pools(spark), pools(spark), variants, n=40).collect()
    assert len(got) == 40
    assert {r.rule_text for r in got} == {"one way", "another"}
    assert {(r.label_train, r.label_test) for r in got} == {(a, b) for a in (0, 1) for b in (0, 1)}
    for r in got:
        assert r.support[0] == "np"[r.label_train]
        assert r.target[0] == "np"[r.label_test]
    assert rows(E.training_samples(spark, pools(spark).where("false"), pools(spark), variants, n=5)) == []


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, [7, 3, 9]), (2, []), (3, None)], "k int, ids array<int>")
    used = V.used_ids(spark.createDataFrame([([7, 3, 7],)], "ids array<int>"))
    vocab = V.vocab_map(used)
    assert rows(vocab) == [(3, 0), (7, 1)]
    assert {r.k: r.ids for r in V.remap(df, vocab, ["k"]).collect()} == {1: [1, 0, 2], 2: [], 3: None}
    matrix = spark.createDataFrame([(3, [1.0, 2.0]), (7, [3.0, 6.0]), (8, [0.0, 0.0])], "id int, v array<float>")
    assert rows(V.gather(vocab, matrix, "id", "v")) == [(0, [1.0, 2.0]), (1, [3.0, 6.0])]
    assert [r.mean for r in V.mean_vector(matrix.where("id < 8"), "v").orderBy("dim").collect()] == [2.0, 4.0]


def test_tokenize_pools_closes_gaps(spark):
    items = spark.createDataFrame([("a", 0, "nan"), ("a", 1, " hi "), ("a", 2, None), ("a", 3, "yo")], "pool_id string, pos long, text string")
    got = V.tokenize_pools(items, V.ByteTokenizer())
    assert rows(got.select("pos", "ids")) == [(0, [104, 105]), (1, [121, 111])]


def test_margin_and_losses(spark):
    logits = spark.createDataFrame([(1, 0, 1.0, 3.0), (1, 1, 0.0, 2.0)], "row_id long, variant int, logit_no double, logit_yes double")
    assert rows(S.aggregate_predictions(logits)) == [(1, 2.0)]
    assert S.logit_bags(logits).first().bag[1].logit_yes == 2.0
    loss = logits.select(S.cross_entropy("logit_no", "logit_yes", F.lit(1)).alias("x")).collect()[0].x
    p = [math.exp(x) / (math.exp(1) + math.exp(3)) for x in (1, 3)]
    assert loss == pytest.approx(-(0.05 * math.log(p[0]) + 0.95 * math.log(p[1])))
    assert math.isfinite(logits.select(S.cross_entropy(F.lit(0.0), F.lit(900.0), F.lit(0))).first()[0])


@pytest.mark.parametrize(
    ("data", "auc"),
    [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.1), (1, 0.8), (0, 0.5), (0, None), (None, 0.3)], 0.5), ([(1, 0.2)], None), ([], None)],
)
def test_auc(spark, data, auc):
    assert S.roc_auc(spark.createDataFrame(data, "label int, score double")).first().auc == auc


def test_merge_predictions(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)], "row_id long, variant int, logit_no double, logit_yes double")
    b = spark.createDataFrame([(2, 1, 1.0, 1.0)], a.schema)
    assert rows(S.merge_predictions(a, b).select("row_id", "variant")) == [(1, 0), (2, 1)]


def test_score_comments_end_to_end(spark, sf):
    test = spark.read.parquet(f"{sf}/test.parquet")

    def scorer(frame):
        return frame[["row_id", "variant"]].assign(logit_no=0.0, logit_yes=frame.support_label.astype(float))

    got = pipelines.score_comments(test, scorer)
    assert got.count() == test.select("row_id").distinct().count()
    assert {r.rule_violation for r in got.collect()} == {0.5}


def test_fragments_are_the_pieces_of_prompts(spark):
    phrasings = spark.createDataFrame([(" Be kind ", 0, "Be kind"), ("Be kind", 1, "No insults")], "rule string, variant_no int, text string")
    got = {(r.fragment, r.rule, r.variant_no): bytes(r.ids).decode() for r in E.prompt_fragments(spark, V.ByteTokenizer(), phrasings).collect()}
    assert got["header", None, None] == E.HEADER
    assert got["rule", "Be kind", 1] == "Rule: No insults\n"
    assert len(got) == 8


def test_sample_ids_and_their_answers(spark):
    data = [(1, "Be kind", "some é support", 1, "target"), (2, "Be kind", None, 0, "x")]
    samples = spark.createDataFrame(data, "sample_id int, rule_text string, support string, label_train int, target string")
    one, two = E.sample_ids(samples, V.ByteTokenizer()).orderBy("sample_id").collect()
    text = bytes(one.ids)
    assert text.decode().count("some é support") == 1
    assert [text[: k + 1][-10:] for k in one.ends] == [b"Violation:", b"Violation:"]
    assert one.ends[1] == len(text) - 1
    assert two.ids is None
