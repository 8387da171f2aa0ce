"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as N
from tallyloom.functions.text_exact import exact
from tallyloom.operators import pools as P
from tallyloom.operators import prompts as E
from tallyloom.operators import scoring as S
from tallyloom.operators import splits as R
from tallyloom.operators import tokens as V
from tallyloom.operators.ordering import global_rank
from tallyloom.plans import pipelines
from tallyloom.schemas import DATA2_SCORES
from tallyloom.sources import sinks
from tallyloom.sources import tables as T
from tallyloom.storage import materialise, new_path, spread
from tallyloom.streaming import comments as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BYTES = V.ByteTokenizer()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _normalised(name: str, function: Callable[[str], Column]) -> None:
    def run(spark: SparkSession, at: str) -> DataFrame:
        rows = spread(T.read_parquet(spark, at, "train", ["src_pos", "body"]))
        return rows.select("src_pos", function("body").alias("text"))

    run.__doc__ = function.__doc__
    QUERIES[name] = run


for _name, _function in {
    "norm_urls": N.normalize_urls, "norm_usernames": N.normalize_usernames, "norm_emails": N.normalize_emails, "norm_subreddits": N.normalize_subreddits,
    "norm_phones": N.normalize_phones, "norm_money": N.normalize_money, "norm_random": N.normalize_random, "norm_ips": N.normalize_ips,
    "norm_timestamps": N.normalize_timestamps, "norm_quotes": N.normalize_quotes, "reduce_characters": N.reduce_characters,
    "reduce_words": N.reduce_words, "reduce_whitespace": N.reduce_whitespace, "norm_text": N.normalize_text, "norm_incremental": N.normalize_incremental,
    "norm_text_exact": lambda c: exact(c, "text"), "strip_text": N.strip,
}.items():
    _normalised(_name, _function)


def _train(spark: SparkSession, at: str) -> DataFrame:
    return T.read_parquet(spark, at, "train")


def _union(spark: SparkSession, at: str) -> DataFrame:
    read = lambda t: T.read_parquet(spark, at, t).drop("created_at")
    return R.toxicity_union(*(read(t) for t in ("data2_positive", "data2_negative", "data3_positive", "data3_negative")))


def _rules(spark: SparkSession, at: str) -> DataFrame:
    return T.read_parquet(spark, at, "rule_def")


@query
def norm_columns(spark: SparkSession, at: str) -> DataFrame:
    """All text columns of the test table, normalised."""
    rows = spread(T.read_parquet(spark, at, "test", ["src_pos", *N.TEXT_COLUMNS]))
    return N.normalize_text_columns(rows)


@query
def sanitize(spark: SparkSession, at: str) -> DataFrame:
    rows = T.read_parquet(spark, at, "train", ["src_pos", "body"])
    return rows.select("src_pos", N.sanitized("body").alias("text")).where("text is not null")


@query
def na_tokens(spark: SparkSession, at: str) -> DataFrame:
    """Texts that stand for a missing value, as a CSV reader takes them."""
    rows = T.read_parquet(spark, at, "train", ["src_pos", "body"])
    return rows.where(N.na_to_null("body").isNull()).select("src_pos", "body")


@query
def rule_labels(spark: SparkSession, at: str) -> DataFrame:
    rows = _train(spark, at).groupBy(N.rule_label("rule").alias("label"), N.rule_line("rule").alias("line"))
    return rows.agg(F.count("*").alias("n_rows"))


@query
def violation_labels(spark: SparkSession, at: str) -> DataFrame:
    """Which side a label puts a body on; other values go nowhere."""
    side = F.when(F.col("rule_violation") == 1, "positives").when(F.col("rule_violation") == 0, "negatives")
    return _train(spark, at).groupBy(F.trim("rule").alias("rule"), side.alias("polarity")).agg(F.count("*").alias("n_rows"))


@query
def toxicity_scan(spark: SparkSession, at: str) -> DataFrame:
    """The four sets as one, counted as they are reported after the scan."""
    return _union(spark, at).groupBy("dataset", "polarity").agg(F.count("*").alias("n_rows"), F.count("comment_text").alias("n_texts"))


@query
def csv_round_trip(spark: SparkSession, at: str) -> DataFrame:
    """Comments written as CSV and read by the typed CSV source."""
    rows = T.read_parquet(spark, at, "test").drop("src_pos", "created_at")
    path = new_path(spark, "csv-test")
    sinks.save_csv(rows, path)
    back = T.read_comments(spark, path, labelled=False)
    return back.groupBy(F.trim("rule").alias("rule")).agg(F.count("*").alias("n_rows"), F.count("body").alias("n_bodies"), F.sum("row_id").alias("sum_row_id"))


@query
def attach_labels(spark: SparkSession, at: str) -> DataFrame:
    docs, labels = T.read_parquet(spark, at, "documents", ["doc_id", "source"]), T.read_parquet(spark, at, "level_label", ["doc_id", "grade"])
    return T.attach_labels(docs, labels, "doc_id", "grade")


@query
def fold_scores(spark: SparkSession, at: str) -> DataFrame:
    rows = T.read_parquet(spark, at, "data2_positive", ["src_pos", "severe_toxicity", "obscene"])
    folded = T.fold_scores(rows, "severe_toxicity", "severe_toxicity", "obscene")
    return folded.select("src_pos", F.when(~F.isnan("severe_toxicity"), F.col("severe_toxicity")).alias("severe_toxicity"))


@query
def polarity_by_score(spark: SparkSession, at: str) -> DataFrame:
    both = T.read_parquet(spark, at, "data2_positive").unionByName(T.read_parquet(spark, at, "data2_negative"))
    return T.by_polarity(both, DATA2_SCORES, 0.33).groupBy("polarity").agg(F.count("*").alias("n_rows"))


@query
def dedup_keep_first(spark: SparkSession, at: str) -> DataFrame:
    return R.keep_first(_union(spark, at), ["dataset", "polarity", "comment_text"], "src_pos").select("dataset", "polarity", "src_pos", "comment_text")


@query
def cross_dedup_anti(spark: SparkSession, at: str) -> DataFrame:
    return R.clean_toxicity(_union(spark, at)).select("dataset", "polarity", "src_pos", "comment_text")


@query
def split_train_holdout(spark: SparkSession, at: str) -> DataFrame:
    return R.split_toxicity(_union(spark, at)).select("split", "dataset", "polarity", "src_pos")


@query
def half_split(spark: SparkSession, at: str) -> DataFrame:
    return R.halves(T.read_parquet(spark, at, "test", ["src_pos"]), "src_pos")


@query
def threshold_scores(spark: SparkSession, at: str) -> DataFrame:
    """Every score that reaches the threshold; NaN and null don't."""
    return P.scored(_union(spark, at), 0.33)


@query
def rule_fanout(spark: SparkSession, at: str) -> DataFrame:
    return P.fan_out(_union(spark, at), _rules(spark, at)).items


@query
def rule_pool_refs(spark: SparkSession, at: str) -> DataFrame:
    """Which pool each rule uses, with its size: a rule without positives stays."""
    pools = P.fan_out(_union(spark, at), _rules(spark, at))
    sizes = pools.items.groupBy("pool_id").agg(F.count("*").alias("n"))
    return pools.refs.join(sizes, "pool_id", "left").select("rule_key", "rule", "polarity", "pool_id", F.coalesce("n", F.lit(0)).alias("n_items"))


@query
def group_by_rule(spark: SparkSession, at: str) -> DataFrame:
    return P.group_by_rule(_train(spark, at), include_body=True)


@query
def group_by_rule_merged(spark: SparkSession, at: str) -> DataFrame:
    """As group_by_rule, with all spellings of a rule taken together."""
    return P.group_by_rule(_train(spark, at), collision="merge")


@query
def grouped_split(spark: SparkSession, at: str) -> DataFrame:
    pools = P.group_by_rule(_train(spark, at), include_body=True)
    return P.split_pools(pools, shared=False)


@query
def split_first_pools(spark: SparkSession, at: str) -> DataFrame:
    return pipelines.toxicity_pools(_union(spark, at), _rules(spark, at))


@query
def group_first_pools(spark: SparkSession, at: str) -> DataFrame:
    return pipelines.toxicity_pools_group_first(_union(spark, at), _rules(spark, at))


@query
def combine_rules(spark: SparkSession, at: str) -> DataFrame:
    """The rules of train and test; of a rule in both, the examples of test."""
    one = P.group_by_rule(_train(spark, at))
    two = P.group_by_rule(T.read_parquet(spark, at, "test"))
    return P.combine(one, two)


@query
def build_pools(spark: SparkSession, at: str) -> DataFrame:
    """The whole offline build, counted as its metadata is."""
    return sinks.metadata(pipelines.build_pools(_train(spark, at), _union(spark, at), _rules(spark, at)))


@query
def pool_stats(spark: SparkSession, at: str) -> DataFrame:
    return P.pool_stats(P.group_by_rule(_train(spark, at), include_body=True))


@query
def shared_negatives(spark: SparkSession, at: str) -> DataFrame:
    return P.negatives_report(P.group_by_rule(_train(spark, at)))


@query
def shared_negatives_of_scores(spark: SparkSession, at: str) -> DataFrame:
    return P.negatives_report(P.fan_out(_union(spark, at), _rules(spark, at), ranked=False).long())


@query
def unique_negatives(spark: SparkSession, at: str) -> DataFrame:
    return P.unique_negatives(P.group_by_rule(_train(spark, at)))


@query
def clean_negatives(spark: SparkSession, at: str) -> DataFrame:
    return P.clean_negatives(P.group_by_rule(_train(spark, at)))


def _test_pools(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    test = T.read_parquet(spark, at, "test")
    return test, P.group_by_rule(test)


@query
def expand_rows(spark: SparkSession, at: str) -> DataFrame:
    return E.expand(T.read_parquet(spark, at, "test", ["src_pos", "row_id"]))


@query
def support_sampler(spark: SparkSession, at: str) -> DataFrame:
    test, pools = _test_pools(spark, at)
    got = E.sample_support(E.expand(test.select("src_pos", "row_id", "rule")), pools, order=["src_pos", "variant"])
    return got.select("src_pos", "row_id", "variant", "support_label", "support_pos", "support")


@query
def support_sampler_reshuffled(spark: SparkSession, at: str) -> DataFrame:
    test, pools = _test_pools(spark, at)
    got = E.sample_support(E.expand(test.select("src_pos", "row_id", "rule"), seed=7), pools, order=["src_pos", "variant"], seed=7)
    return got.select("src_pos", "row_id", "variant", "support_label", "support_pos")


@query
def prompt_build(spark: SparkSession, at: str) -> DataFrame:
    return E.inference_prompts(*_test_pools(spark, at))


@query
def violation_positions(spark: SparkSession, at: str) -> DataFrame:
    test, pools = _test_pools(spark, at)
    got = E.sample_support(E.expand(test.select("src_pos", "rule", "body", "row_id")), pools, order=["src_pos", "variant"])
    places = E.answer_positions(BYTES, "rule", "support", "support_label", "body")
    return got.select("src_pos", "variant", F.get(places, F.lit(0)).alias("first_end"), F.get(places, F.lit(1)).alias("second_end"))


@query
def prompt_tokens(spark: SparkSession, at: str) -> DataFrame:
    """The ids of every prompt, by number and a sum that depends on places."""
    test, pools = _test_pools(spark, at)
    got = E.sample_support(E.expand(test.select("src_pos", "rule", "body", "row_id")), pools, order=["src_pos", "variant"])
    ids = E.prompt_ids(BYTES, "rule", "support", "support_label", "body")
    rows = got.select("src_pos", "variant", ids.alias("ids")).where("ids is not null")
    weighed = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("src_pos", "variant", F.size("ids").alias("n_ids"), weighed.alias("weighed"))


def _variants(spark: SparkSession, at: str) -> DataFrame:
    rules = _train(spark, at).where("rule is not null").select(F.trim("rule").alias("rule")).distinct()
    forms = F.array("rule", F.lower("rule"), F.upper("rule"), F.concat(F.lit("Please note: "), "rule"), F.concat("rule", F.lit("!")))
    return rules.select("rule", F.posexplode(forms).alias("variant_no", "text"))


@query
def training_samples(spark: SparkSession, at: str) -> DataFrame:
    """Samples of an epoch from split pools."""
    split = P.split_pools(P.group_by_rule(_train(spark, at), include_body=True), shared=False)
    placed = materialise(global_rank(split, ["split", "rule", "polarity"], ["text"]), "split")
    side = lambda s: placed.where(F.col("split") == s).select("rule", "polarity", "pos", "text")
    return E.training_samples(spark, side("train"), side("holdout"), _variants(spark, at), n=2000)


def _weighed(ids: str) -> Column:
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)


@query
def training_sample_ids(spark: SparkSession, at: str) -> DataFrame:
    """The ids of an epoch's samples, and where their two answers end."""
    got = E.sample_ids(training_samples(spark, at), BYTES)
    return got.select("sample_id", "label_train", "label_test", F.size("ids").alias("n_ids"), _weighed("ids").alias("weighed"), F.col("ends")[0].alias("first_end"), F.col("ends")[1].alias("second_end"))


@query
def prompt_fragments(spark: SparkSession, at: str) -> DataFrame:
    """The fixed pieces of prompts and the lines of all wordings, encoded."""
    path = new_path(spark, "phrasings")
    _variants(spark, at).write.parquet(path)
    got = E.prompt_fragments(spark, BYTES, T.read_phrasings(spark, path))
    return got.select("fragment", "rule", "variant_no", F.size("ids").alias("n_ids"), _weighed("ids").alias("weighed"))


@query
def tokens_round_trip(spark: SparkSession, at: str) -> DataFrame:
    """Encoded pools written and read again."""
    path = new_path(spark, "tokens")
    sinks.save_tokens(V.tokenize_pools(P.fan_out(_union(spark, at), _rules(spark, at)).items, BYTES), path)
    return sinks.load_tokens(spark, path).groupBy("pool_id").agg(F.count("*").alias("n_items"), F.sum(F.size("ids")).alias("n_ids"), F.max("pos").alias("last_pos"))


@query
def public_tokens(spark: SparkSession, at: str) -> DataFrame:
    """Number of ids of each comment in a public vocabulary."""
    rows = spread(T.read_parquet(spark, at, "train", ["src_pos", "body"]))
    return rows.select("src_pos", V.PublicTokenizer(V.BYTE_BPE, V.BYTE_BPE_PATTERN).length(F.col("body")).alias("n_ids"))


@query
def own_negatives(spark: SparkSession, at: str) -> DataFrame:
    """Which pool each rule uses, where each has negatives of its own."""
    refs = P.group_by_rule(_train(spark, at)).select("rule", "polarity", F.concat_ws("/", "rule", "polarity").alias("pool_id")).distinct()
    return P.own_negatives(refs)


@query
def toxicity_csv(spark: SparkSession, at: str) -> DataFrame:
    """The four sets written as CSV and read as one by the typed source."""
    paths = {}
    for name in ("data2_positive", "data2_negative", "data3_positive", "data3_negative"):
        paths[name] = new_path(spark, name)
        sinks.save_csv(T.read_parquet(spark, at, name).drop("src_pos", "created_at"), paths[name])
    rows = T.read_toxicity(spark, *paths.values())
    high = F.count_if((F.col("severe_toxicity") >= 0.33) & ~F.isnan("severe_toxicity"))
    return rows.groupBy("dataset", "polarity").agg(F.count("*").alias("n_rows"), F.count("comment_text").alias("n_texts"), high.alias("n_severe"))


@query
def stream_violations(spark: SparkSession, at: str) -> DataFrame:
    """Violations per day and rule, counted by a stream over the table's files."""
    source, sink = new_path(spark, "stream"), new_path(spark, "counts")
    train = T.read_parquet(spark, at, "train", ["src_pos", "rule", "rule_violation", "created_at"])
    train.write.parquet(source)
    counts = C.violations_per_window(C.read_comments(spark, source, train.schema))
    run = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink))
    run.trigger(availableNow=True).option("checkpointLocation", new_path(spark, "offsets")).start().awaitTermination()
    got = spark.read.parquet(sink)
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rule", "n_comments", "n_violations")


@query
def tokenize_pools(spark: SparkSession, at: str) -> DataFrame:
    items = P.fan_out(_union(spark, at), _rules(spark, at)).items
    return V.tokenize_pools(items, BYTES).select("pool_id", "pos", F.size("ids").alias("n_ids"))


def _coded(spark: SparkSession, at: str) -> DataFrame:
    return V.encode(spread(T.read_parquet(spark, at, "train", ["src_pos", "body"])), BYTES, text="body")


@query
def token_vocab(spark: SparkSession, at: str) -> DataFrame:
    return V.used_ids(_coded(spark, at))


@query
def vocab_map(spark: SparkSession, at: str) -> DataFrame:
    return V.vocab_map(V.used_ids(_coded(spark, at)))


@query
def vocab_remap(spark: SparkSession, at: str) -> DataFrame:
    """Ids of train in the vocabulary of data2, by number and a sum that
    depends on places."""
    seen = V.used_ids(V.encode(T.read_parquet(spark, at, "data2_positive", ["src_pos", "comment_text"]), BYTES, text="comment_text"))
    rows = V.remap(_coded(spark, at), V.vocab_map(seen), ["src_pos"])
    weighed = F.aggregate(F.transform("ids", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("src_pos", F.size("ids").alias("n_ids"), weighed.alias("weighed"))


def _embeddings(spark: SparkSession, at: str) -> DataFrame:
    return T.read_parquet(spark, at, "embeddings")


@query
def embedding_gather(spark: SparkSession, at: str) -> DataFrame:
    """The rows of the matrix whose ids train uses."""
    vectors, vocab = _embeddings(spark, at), V.vocab_map(V.used_ids(_coded(spark, at)))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return V.gather(vocab, vectors, "vec_id", "embedding").select("new_id", F.size("vec").alias("dims"), F.round(total, 5).alias("total"))


@query
def mean_embedding(spark: SparkSession, at: str) -> DataFrame:
    return V.mean_vector(_embeddings(spark, at), "embedding").select("dim", F.round("mean", 6).alias("mean"))


@query
def head_round_trip(spark: SparkSession, at: str) -> DataFrame:
    """A head written and read again, applied to hidden states."""
    vectors, path = _embeddings(spark, at), new_path(spark, "head")
    sinks.save_head(_head(vectors), path)
    return S.linear_head(vectors, T.read_head(spark, path), "vec_id", "embedding").select("vec_id", "class_id", F.round("logit", 5).alias("logit"))


def _head(vectors: DataFrame) -> DataFrame:
    """Two rows of weights: the first vectors with label 0 and 1."""
    first = vectors.where("label < 2").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("w"))
    return first.select(F.col("label").alias("class_id"), "w")


def _logits(spark: SparkSession, at: str) -> DataFrame:
    vectors = _embeddings(spark, at)
    flat = S.linear_head(vectors, _head(vectors), "vec_id", "embedding")
    both = flat.groupBy("vec_id").agg(
        F.sum(F.when(F.col("class_id") == 0, F.col("logit"))).alias("logit_no"), F.sum(F.when(F.col("class_id") == 1, F.col("logit"))).alias("logit_yes")
    )
    return both.select(F.expr("vec_id div 2").alias("row_id"), (F.col("vec_id") % 2).cast("int").alias("variant"), "logit_no", "logit_yes")


@query
def linear_head(spark: SparkSession, at: str) -> DataFrame:
    vectors = _embeddings(spark, at)
    return S.linear_head(vectors, _head(vectors), "vec_id", "embedding").select("vec_id", "class_id", F.round("logit", 5).alias("logit"))


@query
def logit_bags(spark: SparkSession, at: str) -> DataFrame:
    bags = S.logit_bags(_logits(spark, at))
    return bags.select("row_id", F.size("bag").alias("n_variants"), F.round(F.element_at("bag", -1)["logit_yes"], 5).alias("last_yes"))


@query
def margin_by_row(spark: SparkSession, at: str) -> DataFrame:
    return S.aggregate_predictions(_logits(spark, at)).select("row_id", F.round("rule_violation", 5).alias("rule_violation"))


@query
def best_margin_by_row(spark: SparkSession, at: str) -> DataFrame:
    """Another aggregate of a row's variants."""
    best = S.aggregate_predictions(_logits(spark, at), lambda: F.max(F.col("logit_yes") - F.col("logit_no")))
    return best.select("row_id", F.round("rule_violation", 5).alias("rule_violation"))


@query
def merge_predictions(spark: SparkSession, at: str) -> DataFrame:
    """The logits of two workers, each with its half of the rows."""
    logits = _logits(spark, at)
    split = logits.join(R.halves(logits.select("row_id").distinct(), "row_id"), "row_id")
    worker = lambda k: split.where(F.col("worker") == k).drop("worker")
    merged = S.merge_predictions(worker(0), worker(1))
    return merged.select("row_id", "variant", F.round("logit_yes", 5).alias("logit_yes"))


def _scored(spark: SparkSession, at: str) -> DataFrame:
    truth = _embeddings(spark, at).where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("row_id"), (F.col("label") > 4).cast("int").alias("rule_violation"))
    scores = S.aggregate_predictions(_logits(spark, at)).withColumn("rule_violation", F.round("rule_violation", 2))
    return S.with_truth(truth, scores)


@query
def eval_join(spark: SparkSession, at: str) -> DataFrame:
    return _scored(spark, at)


@query
def roc_auc(spark: SparkSession, at: str) -> DataFrame:
    return S.roc_auc(_scored(spark, at)).select(F.round("auc", 8).alias("auc"))


@query
def ce_loss(spark: SparkSession, at: str) -> DataFrame:
    loss = S.cross_entropy("logit_no", "logit_yes", F.col("variant"))
    return _logits(spark, at).select("row_id", "variant", F.round(loss, 5).alias("loss"))


@query
def epoch_loss(spark: SparkSession, at: str) -> DataFrame:
    loss = S.cross_entropy("logit_no", "logit_yes", F.col("variant"))
    rows = _logits(spark, at).select((F.col("row_id") % 10).alias("epoch"), F.when(F.col("variant") == 0, loss).alias("train_loss"), F.when(F.col("variant") == 1, loss).alias("val_loss"))
    means = S.epoch_losses(rows)
    return means.select("epoch", F.round("train_loss", 5).alias("train_loss"), F.round("val_loss", 5).alias("val_loss"))


def _length_scorer(frame):
    """A stand-in for a model: it scores by the length of the prompt."""
    n = frame.prompt.str.len().fillna(0).astype(float)
    return frame[["row_id", "variant"]].assign(logit_no=n / 1000, logit_yes=n.mod(97) / 100)


@query
def score_comments(spark: SparkSession, at: str) -> DataFrame:
    """Normalised texts, prompts, scores of a pluggable model, one per row."""
    scores = pipelines.score_comments(T.read_parquet(spark, at, "test"), _length_scorer)
    return scores.select("row_id", F.round("rule_violation", 6).alias("rule_violation"))


@query
def submission(spark: SparkSession, at: str) -> DataFrame:
    """Scores written as the two-column CSV and read again."""
    path = new_path(spark, "submission")
    sinks.save_submission(S.aggregate_predictions(_logits(spark, at)), path)
    return spark.read.schema("row_id long, rule_violation double").option("header", True).csv(path).select("row_id", F.round("rule_violation", 5).alias("rule_violation"))


@query
def pools_round_trip(spark: SparkSession, at: str) -> DataFrame:
    """Pools written by split and read again, one split only."""
    path = new_path(spark, "pools")
    sinks.save_pools(P.split_pools(P.group_by_rule(_train(spark, at)), shared=False), path)
    return sinks.load_pools(spark, path, "holdout").groupBy("rule", "polarity").agg(F.count("*").alias("n_items"))
