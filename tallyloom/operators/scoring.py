"""From logits to scores, losses and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import running_total


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def linear_head(hidden: DataFrame, head: DataFrame, key: str, vector: str) -> DataFrame:
    """key, class_id, logit: hidden states times the head's few class rows."""
    weights = F.broadcast(head.select("class_id", "w"))  # a row per class
    return hidden.join(weights).select(key, "class_id", dot(vector, "w").alias("logit"))


def score_prompts(prompts: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "row_id long, variant int, logit_no double, logit_yes double") -> DataFrame:
    """Logits of a model that takes whole batches of prompts. ``scorer`` gets a
    frame of prompts and returns the columns of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield scorer(frame)

    return prompts.mapInPandas(run, schema)


def logit_bags(logits: DataFrame) -> DataFrame:
    """row_id, bag: the logits of a row's few variants in their order."""
    return logits.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("variant", "logit_no", "logit_yes"))).alias("bag"))


def margin() -> Column:
    """Mean of yes less mean of no; there is no softmax in it."""
    return F.avg("logit_yes") - F.avg("logit_no")


def aggregate_predictions(logits: DataFrame, score: Callable[[], Column] = margin) -> DataFrame:
    """row_id, rule_violation: one score per row by any aggregate."""
    return logits.groupBy("row_id").agg(score().alias("rule_violation"))


def merge_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Logits of two workers; of a row that both have, the second's."""
    return first.join(second.select("row_id").distinct(), "row_id", "left_anti").unionByName(second)


def with_truth(truth: DataFrame, scores: DataFrame) -> DataFrame:
    """row_id, label, score: every row of the truth, score null where missing."""
    return truth.select("row_id", F.col("rule_violation").alias("label")).join(
        scores.select("row_id", F.col("rule_violation").alias("score")), "row_id", "left"
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row, auc, by ranks; ties count half. Rows whose label isn't 0 or 1
    or whose score is null or NaN are left out; null without both labels."""
    known = scored.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    each = known.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    summed = running_total(each, ["score"], "n", "below")
    total = summed.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"))
    return total.select((F.col("won") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc"))


def cross_entropy(no: Column | str, yes: Column | str, label: Column | str, smoothing: float = 0.1) -> Column:
    """Loss of two logits against label 0 or 1, with label smoothing."""
    no, yes, label = (F.col(x) if isinstance(x, str) else x for x in (no, yes, label))
    top = F.greatest(no, yes)
    norm = top + F.log(F.exp(no - top) + F.exp(yes - top))
    own = F.when(label == 1, yes).otherwise(no)
    return norm - (1 - smoothing) * own - smoothing / 2 * (no + yes)


def epoch_losses(losses: DataFrame) -> DataFrame:
    """epoch, train_loss, val_loss: means per epoch."""
    return losses.groupBy("epoch").agg(F.avg("train_loss").alias("train_loss"), F.avg("val_loss").alias("val_loss"))
