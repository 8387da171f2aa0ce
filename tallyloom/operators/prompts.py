"""Support examples and prompts.

The cyclic samplers have no state: the draw number of a row is its rank, and
the support it gets is the pool item at that number modulo the pool's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import rule_line
from tallyloom.operators.ordering import global_rank
from tallyloom.operators.tokens import Tokenizer

# The pieces of a prompt.
HEADER = "You are given a comment on reddit. Your task is to classify if it violates the given rule.\n"
COMMENT, LINE_END = "Comment: ", "\n"
VIOLATION, VIOLATION_YES, VIOLATION_NO = "Violation:", "Violation: Yes\n", "Violation: No\n"


def _choice(n: Column | int, seed: int, *parts: Column | str) -> Column:
    """A repeatable number from 0 below n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def expand(df: DataFrame, *, row_id: str = "row_id", order: str = "src_pos", seed: int | None = None) -> DataFrame:
    """Two rows for each row: variant 0 and 1, one with positive and one with
    negative support. Without a seed the positive one comes first; with one,
    a hash of the row decides."""
    first = F.lit(0) if seed is None else _choice(2, seed, F.col(row_id), F.col(order))
    two = df.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    side = F.when((F.col("variant") == first), "positives").otherwise("negatives")
    return two.withColumn("polarity", side)


def _in_epoch_order(pools: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """The pools of all epochs that occur, each in an order of its own."""
    sized = pools.groupBy("rule", "polarity").agg(F.count("*").alias("pool_size"))
    epochs = (
        draws.groupBy("rule", "polarity").agg(F.max("draw").alias("last")).join(sized, ["rule", "polarity"])
        .select("rule", "polarity", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("last div pool_size"))).alias("epoch"))
    )
    shuffled = pools.join(epochs, ["rule", "polarity"])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "rule", "polarity", F.col("epoch").cast("string"), F.col("pos").cast("string")))
    return global_rank(shuffled.withColumn("__order", order), ["rule", "polarity", "epoch"], ["__order", "pos"], "place").drop("__order", "place_of")


def sample_support(rows: DataFrame, pools: DataFrame, *, order: list[str], seed: int | None = None, on_missing: str = "null") -> DataFrame:
    """``rows`` (rule, polarity, ...) with support, support_pos, support_label.

    The k-th row of a rule and polarity, by ``order``, gets the item at k
    modulo the size of the pool; with a seed, every round through a pool has
    an order of its own. Rules are compared trimmed. Where a pool is missing
    or empty the support is null, or with on_missing="error" the query fails.
    """
    trimmed = rows.withColumn("__rule", F.trim("rule"))
    draws = global_rank(trimmed, ["__rule", "polarity"], order, "draw").drop("draw_of")
    items = pools.select(F.trim("rule").alias("rule"), "polarity", F.col("pos").cast("long").alias("pos"), "text")
    sizes = items.groupBy("rule", "polarity").agg(F.count("*").alias("pool_size"))
    named = sizes.select(F.col("rule").alias("__rule"), "polarity", "pool_size")
    draws = draws.join(named, ["__rule", "polarity"], "left")
    if seed is None:
        placed = items.withColumns({"epoch": F.lit(0).cast("long"), "place": F.col("pos")})
        epoch = F.lit(0).cast("long")
    else:
        placed = _in_epoch_order(items, draws.select(F.col("__rule").alias("rule"), "polarity", "draw"), seed)
        epoch = F.expr("draw div pool_size")
    placed = placed.select(
        F.col("rule").alias("__rule"), "polarity", F.col("epoch").alias("__epoch"), F.col("place").alias("__place"),
        F.col("pos").alias("support_pos"), F.col("text").alias("support"),
    )
    found = draws.withColumns({"__epoch": epoch, "__place": F.expr("draw % pool_size")}).join(placed, ["__rule", "polarity", "__epoch", "__place"], "left")
    support = F.col("support_pos")
    if on_missing == "error":
        support = F.when(F.col("pool_size").isNotNull(), support).otherwise(F.raise_error(F.concat(F.lit("no pool for rule "), F.coalesce("rule", F.lit("null")))))
    label = F.when(F.col("polarity") == "positives", 1).otherwise(0)
    return found.withColumns({"support_pos": support, "support_label": label}).drop("__rule", "__epoch", "__place", "pool_size")


def prompt_text(rule: Column | str, support: Column | str, support_label: Column | str, target: Column | str) -> Column:
    """The whole prompt; null where a part is."""
    column = lambda x: F.col(x) if isinstance(x, str) else x
    answer = F.when(column(support_label) == 1, VIOLATION_YES).otherwise(VIOLATION_NO)
    pieces = [F.lit(HEADER), rule_line(rule), F.lit(COMMENT), column(support), F.lit(LINE_END), answer, F.lit(COMMENT), column(target), F.lit(LINE_END + VIOLATION)]
    return F.concat(*pieces)


def prompt_ids(tokenizer: Tokenizer, rule: str, support: str, support_label: str, target: str) -> Column:
    """Ids of the prompt, its pieces encoded apart: the whole text is never
    encoded again, since its ids could differ."""
    ids = tokenizer.constant
    answer = F.when(F.col(support_label) == 1, ids(VIOLATION_YES)).otherwise(ids(VIOLATION_NO))
    return F.concat(
        ids(HEADER), tokenizer.ids(rule_line(rule)), ids(COMMENT), tokenizer.ids(F.col(support)), ids(LINE_END), answer,
        ids(COMMENT), tokenizer.ids(F.col(target)), ids(LINE_END), ids(VIOLATION),
    )


def prompt_fragments(spark: SparkSession, tokenizer: Tokenizer, phrasings: DataFrame) -> DataFrame:
    """fragment, rule, variant_no, ids: the pieces of a prompt that don't depend
    on a comment, each encoded once. The fixed ones have no rule; the others are
    the rule lines of all ``phrasings`` (rule, variant_no, text)."""
    fixed = {"header": HEADER, "comment": COMMENT, "line_end": LINE_END, "violation_yes": VIOLATION_YES, "violation_no": VIOLATION_NO, "violation": VIOLATION}
    none = spark.range(1).select(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("variant_no"))
    each = F.array(*(F.struct(F.lit(k).alias("fragment"), tokenizer.constant(x).alias("ids")) for k, x in fixed.items()))
    out = none.select("rule", "variant_no", F.explode(each).alias("x")).select("x.fragment", "rule", "variant_no", "x.ids")
    lines = phrasings.select(F.lit("rule").alias("fragment"), F.trim("rule").alias("rule"), F.col("variant_no").cast("int").alias("variant_no"), tokenizer.ids(rule_line("text")).alias("ids"))
    return out.unionByName(lines)


def sample_ids(samples: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``samples`` as training_samples gives them, with the ids of each prompt
    and ends, the places of the last id of both "Violation:"."""
    columns = ("rule_text", "support", "label_train", "target")
    return samples.withColumns({"ids": prompt_ids(tokenizer, *columns), "ends": answer_positions(tokenizer, *columns)})


def answer_positions(tokenizer: Tokenizer, rule: str, support: str, support_label: str, target: str) -> Column:
    """The places of the last id of both "Violation:", from 0. Exact if the
    answer lines begin with the ids of "Violation:" itself."""
    n = lambda x: tokenizer.length(F.lit(x))
    before = n(HEADER) + tokenizer.length(rule_line(rule)) + n(COMMENT) + tokenizer.length(F.col(support)) + n(LINE_END)
    answer = F.when(F.col(support_label) == 1, n(VIOLATION_YES)).otherwise(n(VIOLATION_NO))
    total = before + answer + n(COMMENT) + tokenizer.length(F.col(target)) + n(LINE_END) + n(VIOLATION)
    return F.array(before + n(VIOLATION) - 1, total - 1)


def inference_prompts(df: DataFrame, pools: DataFrame, *, seed: int | None = None, on_missing: str = "null") -> DataFrame:
    """row_id, src_pos, variant, support_label, prompt: two prompts per row."""
    rows = expand(df.select("row_id", "src_pos", "rule", "body"), seed=seed)  # only what the ranks below carry along
    got = sample_support(rows, pools, order=["src_pos", "variant"], seed=seed, on_missing=on_missing)
    return got.select("row_id", "src_pos", "variant", "support_label", prompt_text("rule", "support", "support_label", "body").alias("prompt"))


def training_samples(spark: SparkSession, train: DataFrame, holdout: DataFrame, variants: DataFrame, *, n: int, seed: int = 42) -> DataFrame:
    """``n`` samples of a rule, a support from its train pool and a target from
    its holdout pool, each of either polarity, and a phrasing of the rule.

    sample_id, rule, label_train, label_test, idx (the target's place in its
    pool), rule_text, support, target. Supports go round in new orders, targets
    in one shuffled order. ``variants``: rule, variant_no from 0, text; a rule
    without any is named by itself.
    """
    rules = global_rank(train.select(F.trim("rule").alias("rule")).distinct(), [], ["rule"], "rule_no").withColumnRenamed("rule_no_of", "n_rules")
    n_rules = train.agg(F.countDistinct(F.trim("rule")).alias("n_rules"))
    draws = spark.range(n).withColumnRenamed("id", "sample_id").join(F.broadcast(n_rules))  # one row
    draws = draws.where("n_rules > 0").withColumns(
        {
            "rule_no": _choice(F.col("n_rules"), seed, F.lit("rule"), F.col("sample_id")),
            "label_train": _choice(2, seed, F.lit("train"), F.col("sample_id")).cast("int"),
            "label_test": _choice(2, seed, F.lit("test"), F.col("sample_id")).cast("int"),
        }
    )
    draws = draws.drop("n_rules").join(rules.select("rule", "rule_no"), "rule_no").drop("rule_no")
    side = lambda label: F.when(F.col(label) == 1, "positives").otherwise("negatives")
    support = sample_support(draws.withColumn("polarity", side("label_train")), train, order=["sample_id"], seed=seed)
    support = support.drop("polarity", "draw", "support_pos", "support_label").withColumnRenamed("support", "support_text")
    # the order of the holdout pools is shuffled once
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("holdout"), "rule", "polarity", F.col("pos").cast("string")))
    once = global_rank(holdout.withColumn("__order", order), ["rule", "polarity"], ["__order", "pos"], "place").select("rule", "polarity", F.col("place").alias("pos"), "text")
    got = sample_support(support.withColumn("polarity", side("label_test")), once, order=["sample_id"])
    counts = variants.groupBy(F.trim("rule").alias("rule")).agg(F.count("*").alias("n_variants"))
    got = got.join(counts, "rule", "left").withColumn("variant_no", _choice(F.coalesce("n_variants", F.lit(1)), seed, F.lit("variant"), F.col("sample_id")))
    phrased = variants.select(F.trim("rule").alias("rule"), F.col("variant_no").cast("long").alias("variant_no"), F.col("text").alias("phrase"))
    return got.join(phrased, ["rule", "variant_no"], "left").select(
        "sample_id", "rule", "label_train", "label_test", F.col("support_pos").alias("idx"), F.coalesce("phrase", "rule").alias("rule_text"),
        F.col("support_text").alias("support"), F.col("support").alias("target"),
    )
