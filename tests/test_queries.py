"""Every query runs; those with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import scoring as S

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not n[1:2].isdigit()]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(columns, data):
    """Rows with sorted columns, values as text, without order."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(value(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_same_as_sql(spark, sf, duck, name):
    want = duck.execute(SQL[name])
    names, data = [c[0] for c in want.description], want.fetchall()
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, got.collect()) == plain(names, data)


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_result_does_not_depend_on_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = plain(["a"] * 4, QUERIES["grouped_split"](spark, sf).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert plain(["a"] * 4, QUERIES["grouped_split"](spark, sf).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder of 60 vectors: row_id 0 to 29 with two variants each."""
    at = str(tmp_path_factory.mktemp("vectors"))
    data = [(k, k * 7 % 10, [float(k * k % 11), 1.0, float(k % 5)]) for k in range(60)]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_every_row_is_evaluated(spark, vectors):
    scored = {r.row_id: r for r in QUERIES["eval_join"](spark, vectors).collect()}
    assert sorted(scored) == list(range(30))
    margins = {r.row_id: r.rule_violation for r in QUERIES["margin_by_row"](spark, vectors).collect()}
    assert {k: r.score for k, r in scored.items()} == pytest.approx({k: round(m, 2) for k, m in margins.items()})
    yes, no = ([r.score for r in scored.values() if r.label == x] for x in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert QUERIES["roc_auc"](spark, vectors).first().auc == pytest.approx(want, abs=1e-8)


def test_two_workers_give_every_row(spark, vectors):
    merged = QUERIES["merge_predictions"](spark, vectors).collect()
    assert sorted((r.row_id, r.variant) for r in merged) == [(k, v) for k in range(30) for v in (0, 1)]
    logits = {(r.vec_id // 2, r.vec_id % 2): r.logit for r in QUERIES["linear_head"](spark, vectors).where("class_id = 1").collect()}
    assert {(r.row_id, r.variant): r.logit_yes for r in merged} == pytest.approx(logits)


def test_overlapping_workers(spark):
    schema = "row_id long, variant int, logit_no double, logit_yes double"
    first = spark.createDataFrame([(k, v, 0.0, 1.0) for k in (1, 2, 3) for v in (0, 1)], schema)
    second = spark.createDataFrame([(2, 0, 0.0, 2.0), (3, 0, 0.0, 2.0), (3, 1, 0.0, 2.0), (4, 1, 0.0, 2.0)], schema)
    got = sorted((r.row_id, r.variant, r.logit_yes) for r in S.merge_predictions(first, second).collect())
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 2.0), (3, 0, 2.0), (3, 1, 2.0), (4, 1, 2.0)]


def test_missing_scores(spark):
    truth = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "row_id long, rule_violation int")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25), (9, 1.0)], "row_id long, rule_violation double")
    scored = S.with_truth(truth, scores)
    assert sorted((r.row_id, r.label, r.score) for r in scored.collect()) == [(1, 1, 0.5), (2, 0, 0.25), (3, 1, None)]
    assert S.roc_auc(scored).first().auc == 1.0


def test_combined_rules_have_all_examples_of_test(spark, tmp_path):
    """Of differing rule sets: train's own, test's own, and test's of both."""
    examples = [f"{p}_example_{k}" for p in ("positive", "negative") for k in (1, 2)]
    schema = "src_pos long, row_id long, body string, rule string, subreddit string, " + ", ".join(f"{c} string" for c in examples)
    table = lambda t, data: spark.createDataFrame([(k, k, f"{t} body {k}", rule, "r/x", *(f"{t} {c} {k}" for c in examples)) for k, rule in data], schema)
    train = table("train", [(0, "No spam"), (1, "Be kind")]).withColumn("rule_violation", F.lit(1))
    train.write.parquet(f"{tmp_path}/train.parquet")
    table("test", [(0, "No spam"), (1, "No spam"), (3, "No spam"), (4, "No links"), (5, "No links"), (7, None)]).write.parquet(f"{tmp_path}/test.parquet")
    got = {}
    for r in QUERIES["combine_rules"](spark, str(tmp_path)).collect():
        got.setdefault(r.rule, set()).add(r.text)
    texts = lambda t, *rows: {f"{t} {c} {k}" for c in examples for k in rows}
    assert got["Be kind"] == texts("train", 1)
    assert got["No links"] == texts("test", 4, 5)
    assert set(got) == {"Be kind", "No links", "No spam"}
    assert got["No spam"] == texts("test", 0, 1, 3)
