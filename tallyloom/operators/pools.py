"""Pools of positive and negative examples for each rule.

A pool is kept in long form, (rule, polarity, pos, text); negatives that all
score rules share are stored once and referred to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import global_rank
from tallyloom.operators.splits import split_by_hash
from tallyloom.schemas import DATA2_SCORES, DATA3_SCORES


def rule_examples(df: DataFrame, *, include_body: bool = False, collision: str = "last") -> DataFrame:
    """rule, polarity, src_no, src_pos, text: all examples in long form.

    Rules are trimmed; null rules drop out. Of several spellings that are equal
    when trimmed, "last" keeps the one seen last, "merge" keeps all. Bodies
    count by rule_violation, 1 or 0; other values nowhere.
    """
    slots = [("positives", 1, "positive_example_1"), ("positives", 2, "positive_example_2"), ("negatives", 1, "negative_example_1"), ("negatives", 2, "negative_example_2")]
    items = [F.struct(F.lit(p).alias("polarity"), F.lit(n).alias("src_no"), F.col(c).alias("text")) for p, n, c in slots]
    if include_body:
        side = F.when(F.col("rule_violation") == 1, "positives").when(F.col("rule_violation") == 0, "negatives")
        items.append(F.struct(side.alias("polarity"), F.lit(3).alias("src_no"), F.col("body").alias("text")))
    rows = df.where("rule is not null").select(F.col("rule").alias("spelling"), F.trim("rule").alias("rule"), "src_pos", F.explode(F.array(*items)).alias("x"))
    if collision == "last":
        seen = df.where("rule is not null").groupBy(F.col("rule").alias("spelling")).agg(F.min("src_pos").alias("seen"))
        last = seen.groupBy(F.trim("spelling").alias("rule")).agg(F.max_by("spelling", "seen").alias("spelling"))
        rows = rows.join(last, ["rule", "spelling"])
    elif collision != "merge":
        raise ValueError(f"unknown collision: {collision}")
    return rows.select("rule", "x.polarity", "x.src_no", "src_pos", "x.text").where("polarity is not null")


def group_by_rule(df: DataFrame, *, include_body: bool = False, collision: str = "last") -> DataFrame:
    """rule, polarity, pos, text: each text once per rule and polarity, in the
    order of its first occurrence. A text may stand on both sides; a null
    text counts once."""
    first = (
        rule_examples(df, include_body=include_body, collision=collision)
        .groupBy("rule", "polarity", "text")
        .agg(F.min(F.struct("src_no", "src_pos")).alias("seen"))
    )
    return global_rank(first, ["rule", "polarity"], ["seen"]).select("rule", "polarity", "pos", "text")


def nested(pools: DataFrame) -> DataFrame:
    """rule, positives, negatives: the arrays of a rule, for small pools at
    the edge of the engine."""
    side = lambda p: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("pos", "text")))), lambda x: x["text"]
    ).alias(p)
    return pools.groupBy("rule").agg(side("positives"), side("negatives"))


@dataclass(frozen=True)
class ScorePools:
    """items: pool_id, pos, text, and what they were grouped by besides; refs:
    rule_key, rule, polarity, pool_id."""

    items: DataFrame
    refs: DataFrame

    def long(self) -> DataFrame:
        """rule_key, rule, polarity, and the items but for pool_id; a rule without
        examples has no row."""
        own = [c for c in self.items.columns if c != "pool_id"]
        return self.refs.join(self.items, "pool_id").select("rule_key", "rule", "polarity", *own)


def scored(union: DataFrame, threshold: float, text: str = "comment_text", order: str = "src_pos", by: Sequence[str] = ()) -> DataFrame:
    """rule_key, dataset, src_pos, text and the columns ``by`` of positives whose score reaches the
    threshold: one row for every score that does. NaN doesn't."""
    pairs = {2: DATA2_SCORES, 3: DATA3_SCORES}
    every = dict.fromkeys(c for scores in pairs.values() for c in scores)
    items = [F.struct(F.lit(c).alias("rule_key"), F.col(c).alias("score"), F.array(*(F.lit(d) for d in pairs if c in pairs[d])).alias("sets")) for c in every]
    rows = union.where("polarity = 'positives'").select(*by, "dataset", F.col(order).alias("src_pos"), F.col(text).alias("text"), F.explode(F.array(*items)).alias("x"))
    reached = (F.col("x.score") >= threshold) & ~F.isnan("x.score") & F.array_contains("x.sets", F.col("dataset"))
    return rows.where(reached).select("x.rule_key", "dataset", "src_pos", "text", *by)


def fan_out(
    union: DataFrame, rule_def: DataFrame, *, threshold: float = 0.33, text: str = "comment_text", order: str = "src_pos", by: Sequence[str] = (), ranked: bool = True
) -> ScorePools:
    """Pools of the score rules from toxicity_union: positives by score, the
    second set before the third; negatives of both sets once, for all rules.
    ``by``: columns whose values have pools of their own. Without ``ranked`` the
    items have no places (pos is null), which saves the sort."""
    positives = scored(union, threshold, text, order, by).withColumn("pool_id", F.concat("rule_key", F.lit("/positives")))
    negatives = union.where("polarity = 'negatives'").select("dataset", F.col(order).alias("src_pos"), F.col(text).alias("text"), *by)
    items = positives.drop("rule_key").unionByName(negatives.withColumn("pool_id", F.lit("shared/negatives")))
    if ranked:
        items = global_rank(items, [*by, "pool_id"], ["dataset", "src_pos"])
    else:
        items = items.withColumn("pos", F.lit(None).cast("long"))
    items = items.select("pool_id", "pos", "text", *by)
    known = rule_def.where(F.col("rule_key").isin(*dict.fromkeys((*DATA2_SCORES, *DATA3_SCORES))))
    refs = known.select("rule_key", "rule", F.lit("positives").alias("polarity"), F.concat("rule_key", F.lit("/positives")).alias("pool_id")).unionByName(
        known.select("rule_key", "rule", F.lit("negatives").alias("polarity"), F.lit("shared/negatives").alias("pool_id"))
    )
    return ScorePools(items, refs)


def combine(pools: DataFrame, other: DataFrame, key: str = "rule") -> DataFrame:
    """The rules of both; of a rule in both, what ``other`` has."""
    return pools.join(other.select(key).distinct(), key, "left_anti").unionByName(other)


def negatives_report(pools: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row: fully_shared, partially_shared, total_unique, n_rules.

    Fully: all rules have the same set of negatives. Partially: some text is
    in the set of every rule. Both hold for one rule and for none. ``rules``
    names rules that may have no negatives at all.
    """
    names = (rules if rules is not None else pools).select("rule").distinct().agg(F.count("*").alias("n_rules"))
    each = pools.where("polarity = 'negatives'").groupBy("text").agg(F.countDistinct("rule").alias("n"))
    counts = each.agg(F.count("*").alias("total_unique"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    both = names.join(F.broadcast(counts))  # one row each
    full = (F.col("n_rules") <= 1) | (F.col("total_unique") == 0) | (F.col("least") == F.col("n_rules"))
    part = (F.col("n_rules") <= 1) | (F.col("most") == F.col("n_rules"))
    return both.select(full.alias("fully_shared"), part.alias("partially_shared"), "total_unique", "n_rules")


def own_negatives(refs: DataFrame) -> DataFrame:
    """``refs`` as they are; the query fails if two rules refer to one pool of
    negatives. Sharing is harmless here, since no pool is shuffled in place;
    this is for those who want each rule to have its own."""
    users = refs.where("polarity = 'negatives'").groupBy("pool_id").agg(F.countDistinct("rule").alias("__users"))
    checked = F.when(F.coalesce("__users", F.lit(0)) <= 1, F.col("pool_id")).otherwise(F.raise_error(F.lit("negatives are shared between rules")))
    return refs.join(users, "pool_id", "left").withColumn("pool_id", checked).select(*refs.columns)


def unique_negatives(pools: DataFrame) -> DataFrame:
    """rule, unique_count of its negatives; null and the empty text are two."""
    each = F.struct(F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return pools.where("polarity = 'negatives'").groupBy("rule").agg(F.countDistinct(each).alias("unique_count"))


def clean_negatives(pools: DataFrame) -> DataFrame:
    """The texts of all negatives once, without null and empty ones."""
    return pools.where("polarity = 'negatives' and text is not null and text <> ''").select("text").distinct()


def negatives_are_shared(pools: DataFrame) -> bool:
    """Whether all rules have one set of negatives; true for a single rule."""
    return bool(negatives_report(pools.where("text is not null and text <> ''"), pools).first().fully_shared)


def split_pools(pools: DataFrame, *, fraction: float = 0.7, seed: int = 42, shared: bool | None = None) -> DataFrame:
    """split, rule, polarity, text: an exact split of every pool.

    Shared negatives are cleaned, split once and stand under the rule "*";
    others are split by rule as they are. ``shared`` None: found out.
    """
    shared = negatives_are_shared(pools) if shared is None else shared
    own = pools if not shared else pools.where("polarity = 'positives'")
    out = split_by_hash(own.select("rule", "polarity", "text"), ["rule", "polarity"], "text", fraction=fraction, seed=seed, prefix=["rule", "polarity"])
    if shared:
        once = clean_negatives(pools).withColumns({"rule": F.lit("*"), "polarity": F.lit("negatives")})
        out = out.unionByName(split_by_hash(once, ["rule", "polarity"], "text", fraction=fraction, seed=seed, prefix=["rule", "polarity"]))
    return out.select("split", "rule", "polarity", "text")


def pool_stats(pools: DataFrame, keys: tuple[str, ...] = ("rule",)) -> DataFrame:
    """Counts per rule, and over all rules where the keys are null."""
    side = lambda p: F.count_if(F.col("polarity") == p).alias(f"n_{p}")
    unique = F.countDistinct(F.when(F.col("polarity") == "negatives", F.col("text"))).alias("n_unique_negatives")
    return pools.rollup(*keys).agg(side("positives"), side("negatives"), unique)
