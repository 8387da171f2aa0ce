"""Sinks: pools, tokens, submissions and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schemas import POOL_TOKENS


def save_pools(pools: DataFrame, path: str) -> None:
    """split, rule, polarity, pos, text by split, and beside them the counts.
    Empty pools are written like any others."""
    pools.write.mode("overwrite").partitionBy("split").parquet(f"{path}/pools")
    metadata(pools).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_pools(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Pools that were saved; of one split only its folder is read."""
    df = spark.read.parquet(f"{path}/pools")
    return df if split is None else df.where(F.col("split") == split)


def metadata(pools: DataFrame) -> DataFrame:
    """split, rule, polarity, n_items."""
    return pools.groupBy("split", "rule", "polarity").agg(F.count("*").alias("n_items"))


def save_tokens(tokens: DataFrame, path: str) -> None:
    """pool_id, pos, ids as Parquet."""
    tokens.write.mode("overwrite").parquet(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POOL_TOKENS).parquet(path)


def save_head(head: DataFrame, path: str) -> None:
    """class_id, w of a model's few classes, as one Parquet file."""
    head.select("class_id", "w").coalesce(1).write.mode("overwrite").parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """Texts as they are, outer blanks, quotes and line ends included, so that
    read_csv gets them back."""
    kept = {"header": True, "quoteAll": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def save_submission(scores: DataFrame, path: str) -> None:
    """row_id, rule_violation as one CSV with a header: a row per test row."""
    rows = scores.select(F.col("row_id").cast("long").alias("row_id"), F.col("rule_violation").cast("double").alias("rule_violation"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
