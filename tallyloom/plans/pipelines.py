"""Whole dataflows, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import normalize_text_columns
from tallyloom.operators.pools import combine, fan_out, group_by_rule, split_pools
from tallyloom.operators.prompts import inference_prompts
from tallyloom.operators.scoring import aggregate_predictions, score_prompts
from tallyloom.operators.splits import split_by_hash, split_toxicity
from tallyloom.storage import materialise, spread


#: The name that shared negatives of the score rules stand under.
SCORE_NEGATIVES = "*scores"


def _score_pools(union: DataFrame, rule_def: DataFrame, threshold: float, by: Sequence[str] = (), ranked: bool = True) -> DataFrame:
    """rule, polarity, pos, text and the columns ``by``: positives by rule, the
    shared negatives once."""
    pools = fan_out(union, rule_def, threshold=threshold, by=by, ranked=ranked)
    own = pools.long().where("polarity = 'positives'").select("rule", "polarity", "pos", "text", *by)
    shared = pools.items.where("pool_id = 'shared/negatives'")
    return own.unionByName(shared.select(F.lit(SCORE_NEGATIVES).alias("rule"), F.lit("negatives").alias("polarity"), "pos", "text", *by))


def toxicity_pools(
    union: DataFrame, rule_def: DataFrame, *, threshold: float = 0.33, fraction: float = 0.7, seed: int = 42, ranked: bool = True
) -> DataFrame:
    """split, rule, polarity, pos, text of the score rules: the texts are
    cleaned and split first, then handed to every rule they score for."""
    rows = materialise(split_toxicity(union, fraction=fraction, seed=seed), "split")
    return _score_pools(rows, rule_def, threshold, ["split"], ranked).select("split", "rule", "polarity", "pos", "text")


def toxicity_pools_group_first(union: DataFrame, rule_def: DataFrame, *, threshold: float = 0.33, fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """split, rule, polarity, text: handed to the rules first, without
    cleaning, and each pool split then. Shared negatives are cleaned and split
    once."""
    pools = _score_pools(union, rule_def, threshold, ranked=False)
    negatives = pools.where("polarity = 'negatives' and text is not null and text <> ''").select("rule", "polarity", "text").distinct()
    both = pools.where("polarity = 'positives'").select("rule", "polarity", "text").unionByName(negatives)
    out = split_by_hash(both, ["rule", "polarity"], "text", fraction=fraction, seed=seed, prefix=["rule", "polarity"])
    return out.select("split", "rule", "polarity", "text")


def build_pools(train: DataFrame, union: DataFrame, rule_def: DataFrame, *, threshold: float = 0.33, fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """split, rule, polarity, text of all rules: those of the comment table
    split by rule, those of the scores; of a rule in both, the scores'."""
    own = split_pools(group_by_rule(train, include_body=True), fraction=fraction, seed=seed)
    return combine(own, toxicity_pools(union, rule_def, threshold=threshold, fraction=fraction, seed=seed, ranked=False).drop("pos"))


def score_comments(test: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], *, pools: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """row_id, rule_violation: texts are normalised, supports drawn from the
    pools (by default the examples of the rows themselves), prompts scored,
    and the variants of a row put together."""
    # every rank below reads the texts again: they are normalised once
    clean = materialise(normalize_text_columns(spread(test)), "normalised")
    pools = group_by_rule(clean) if pools is None else pools
    return aggregate_predictions(score_prompts(inference_prompts(clean, pools, seed=seed), scorer))
