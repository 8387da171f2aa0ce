"""Deduplication, precedence between sets, and exact hash-ordered splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import global_rank, hash_order


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each combination of ``keys``; nulls are
    equal. Aggregated before the shuffle, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__first"))
    return first.select(*(F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns))


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``other``. Null equals null."""
    taken = other.select(F.col(key).alias("__taken")).distinct()
    return df.join(taken, df[key].eqNullSafe(taken["__taken"]), "left_anti")


def split_by_hash(df: DataFrame, group: Sequence[str], key: str, *, fraction: float = 0.7, seed: int = 42, prefix: Sequence[str] = ()) -> DataFrame:
    """``df`` with the column split: in each group, the first
    floor(n * fraction) rows in shuffled order are train, the others holdout.

    The order is that of a hash of seed, ``prefix`` and key, so the same rows
    fall on the same side in every run and on every cluster."""
    ranked = global_rank(df, group, [hash_order(seed, *prefix, key), key], "__place")
    cut = F.floor(F.col("__place_of") * F.lit(float(fraction)))
    return ranked.withColumn("split", F.when(F.col("__place") < cut, "train").otherwise("holdout")).drop("__place", "__place_of")


def halves(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with the column worker: 0 for the first floor(n / 2) rows in
    shuffled order, 1 for the others."""
    ranked = global_rank(df, [], [hash_order(seed, key), key], "__place")
    return ranked.withColumn("worker", (F.col("__place") >= F.floor(F.col("__place_of") / 2)).cast("int")).drop("__place", "__place_of")


def toxicity_union(data2_pos: DataFrame, data2_neg: DataFrame, data3_pos: DataFrame, data3_neg: DataFrame) -> DataFrame:
    """The four toxicity tables as one, with dataset (2, 3) and polarity;
    scores that a set doesn't have are null."""
    parts = [
        df.withColumns({"dataset": F.lit(dataset), "polarity": F.lit(polarity)})
        for df, dataset, polarity in (
            (data2_pos, 2, "positives"), (data2_neg, 2, "negatives"), (data3_pos, 3, "positives"), (data3_neg, 3, "negatives"),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def clean_toxicity(union: DataFrame, text: str = "comment_text", order: str = "src_pos") -> DataFrame:
    """Each text once per set and polarity; texts of the third set, whatever
    their polarity, are taken out of the second."""
    once = keep_first(union, ["dataset", "polarity", text], order)
    return without(once.where("dataset = 2"), once.where("dataset = 3"), text).unionByName(once.where("dataset = 3"))


def split_toxicity(union: DataFrame, *, text: str = "comment_text", order: str = "src_pos", fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """clean_toxicity, then an exact split of each set and polarity."""
    return split_by_hash(clean_toxicity(union, text, order), ["dataset", "polarity"], text, fraction=fraction, seed=seed)
