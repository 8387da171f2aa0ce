from pyspark.sql import functions as F

from tallyloom.operators.pools import group_by_rule
from tallyloom.streaming import comments as C


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_prompts_of_a_stream(spark, sf, tmp_path):
    test = spark.read.parquet(f"{sf}/test.parquet").where("rule is not null")
    test.repartition(3).write.parquet(str(tmp_path / "in"))
    pools = group_by_rule(test)
    got = run(C.stream_prompts(C.read_comments(spark, str(tmp_path / "in"), test.schema, files_at_a_time=1), pools), "prompts")
    whole = C.stream_prompts(test, pools)
    assert got.count() == whole.count() > 0
    assert got.exceptAll(whole).count() == 0


def test_violations_per_window(spark, sf, tmp_path):
    train = spark.read.parquet(f"{sf}/train.parquet").select("created_at", "rule", "rule_violation")
    train.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(C.violations_per_window(C.read_comments(spark, str(tmp_path / "in"), train.schema)), "violations", "complete")
    assert got.agg(F.sum("n_comments")).first()[0] == train.where("created_at is not null").count()
