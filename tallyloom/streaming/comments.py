"""New comments as they come: the stateless steps, in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import normalize_text_columns
from tallyloom.operators.prompts import expand, prompt_text


def read_comments(spark: SparkSession, folder: str, schema: T.StructType, *, files_at_a_time: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def stream_prompts(comments: DataFrame, pools: DataFrame, *, seed: int | None = None) -> DataFrame:
    """row_id, variant, support_label, prompt of streamed comments. There is no
    draw number in a stream: the row's hash picks the support."""
    sizes = pools.groupBy(F.trim("rule").alias("rule_key"), "polarity").agg(F.count("*").alias("pool_size"))
    items = pools.select(F.trim("rule").alias("rule_key"), "polarity", F.col("pos").cast("long").alias("place"), F.col("text").alias("support"))
    rows = expand(normalize_text_columns(comments), seed=seed).withColumn("rule_key", F.trim("rule"))
    rows = rows.join(sizes, ["rule_key", "polarity"]).withColumn("place", F.pmod(F.xxhash64("row_id"), F.col("pool_size")))
    got = rows.join(items, ["rule_key", "polarity", "place"]).withColumn("support_label", F.when(F.col("polarity") == "positives", 1).otherwise(0))
    return got.select("row_id", "variant", "support_label", prompt_text("rule", "support", "support_label", "body").alias("prompt"))


def violations_per_window(comments: DataFrame, *, time: str = "created_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window_start, rule, n_comments, n_violations of a labelled stream; rows
    later than the watermark are left out."""
    return (
        comments.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), F.trim("rule").alias("rule"))
        .agg(F.count("*").alias("n_comments"), F.count_if(F.col("rule_violation") == 1).alias("n_violations"))
        .select(F.col("w.start").alias("window_start"), "rule", "n_comments", "n_violations")
    )
