"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.disclosure import personal_details, sanitised
from tallyloom.llm.exact_copies import Copies, formatting_copies
from tallyloom.llm.leaked_passages import leaked_passages, without_leaks
from tallyloom.llm.lookalikes import consistent_form
from tallyloom.llm.near_copies import NearCopies, near_copies
from tallyloom.llm.reading_level import fit_ranker, reading_levels
from tallyloom.llm.source_mix import Mix, mix_sources
from tallyloom.llm.split_overlap import SplitOverlap, split_overlap


def _texts(spark: SparkSession, at: str, **columns: str) -> DataFrame:
    """tbl, src_pos, text of the named column of each table."""
    parts = [spark.read.parquet(f"{at}/{t}.parquet").select(F.lit(t).alias("tbl"), "src_pos", F.col(c).alias("text")) for t, c in columns.items()]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _copies(spark: SparkSession, at: str, **options: int) -> Copies:
    return formatting_copies(_texts(spark, at, train="body", data3_positive="comment_text"), id_col="src_pos", text_col="text", group_col="tbl", **options)


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    copies = _copies(spark, at).copies
    return copies.select(F.col("grp").alias("tbl"), F.col("first_id").alias("first_src_pos"), F.col("copy_id").alias("copy_src_pos"))


def p1_collapsed(spark: SparkSession, at: str) -> DataFrame:
    """Every comment once, with its number of copies, however short. Rows without
    text stay as they are; blank ones are one comment."""
    return _copies(spark, at, min_words=0).collapsed().select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"), "copies")


def _consistent(spark: SparkSession, at: str) -> DataFrame:
    return consistent_form(_texts(spark, at, train="body", data3_positive="comment_text"), id_col="src_pos", text_col="text", group_col="tbl")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return _consistent(spark, at).where("variants <> 0").select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"))


def p4_consistent_text(spark: SparkSession, at: str) -> DataFrame:
    """Every text in its one consistent form."""
    return _consistent(spark, at).select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"), "text", "variants")


def _near(spark: SparkSession, at: str) -> NearCopies:
    return near_copies(_texts(spark, at, train="body", data3_negative="comment_text"), id_col="src_pos", text_col="text", group_col="tbl")


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = _near(spark, at).all_pairs()
    return pairs.select(F.col("grp").alias("tbl"), F.col("id_a").alias("src_pos_a"), F.col("id_b").alias("src_pos_b"))


def p5_classes(spark: SparkSession, at: str) -> DataFrame:
    """Every comment of 12 words or more with its class of equal bags of words,
    the size of the class and the number of comments that are near-same to it."""
    return _near(spark, at).links().select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"), F.col("class_id").alias("class_src_pos"), "copies", "links")


def _free_texts(spark: SparkSession, at: str) -> DataFrame:
    train, data3 = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("train", "data3_positive"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("body", "positive_example_1"))))
    one = train.select(F.lit("train").alias("grp"), F.col("src_pos").alias("id"), each.alias("x")).select("grp", "id", "x.field", "x.text")
    return one.unionByName(
        data3.select(F.lit("data3_positive").alias("grp"), F.col("src_pos").alias("id"), F.lit("comment_text").alias("field"), F.col("comment_text").alias("text"))
    )


def _details(spark: SparkSession, at: str) -> DataFrame:
    return personal_details(_free_texts(spark, at), spark.read.parquet(f"{at}/name_list.parquet")).details


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return _details(spark, at).select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"), "field", "kind", F.col("start").alias("start_pos"))


def p2_sanitised(spark: SparkSession, at: str) -> DataFrame:
    """Every text with placeholders for its personal details."""
    texts = sanitised(_free_texts(spark, at), _details(spark, at))
    return texts.select(F.col("grp").alias("tbl"), F.col("id").alias("src_pos"), "field", "text")


def _overlap(spark: SparkSession, at: str) -> SplitOverlap:
    fields = ("body", "positive_example_1", "negative_example_1")
    test = spark.read.parquet(f"{at}/test.parquet").select(F.col("src_pos").alias("id"), F.lit("body").alias("field"), F.col("body").alias("text"))
    train = spark.read.parquet(f"{at}/train.parquet")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields)))
    return split_overlap(test, train.select(F.col("src_pos").alias("id"), each.alias("x")).select("id", "x.field", "x.text"))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    rows = _overlap(spark, at).rows()
    return rows.select(F.col("held_id").alias("test_src_pos"), F.col("other_id").alias("train_src_pos"), F.col("field").alias("train_field"))


def p3_by_source(spark: SparkSession, at: str) -> DataFrame:
    """Overlaps by field and by the subreddit of the test row."""
    test = spark.read.parquet(f"{at}/test.parquet")
    source = F.regexp_replace(F.lower(F.trim("subreddit")), "^/?r/", "").alias("subreddit")
    rows = _overlap(spark, at).rows().join(test.select(F.col("src_pos").alias("held_id"), source), "held_id")
    return rows.groupBy("field", "subreddit").agg(
        F.count("*").alias("n_overlaps"),
        F.countDistinct("held_id").alias("n_test_rows"),
        F.count_if(F.col("shared_chunks") == 1).alias("n_whole"),
        F.round(F.avg("shared_chunks"), 6).alias("mean_shared_chunks"),
    )


def _leaks(spark: SparkSession, at: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "eval_items"))
    return leaked_passages(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text")


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return _leaks(spark, at).select("doc_id", "item_id").distinct()


def p6_by_item(spark: SparkSession, at: str) -> DataFrame:
    """Every item, with the documents that hold a passage of it."""
    leaks = _leaks(spark, at).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))
    items = spark.read.parquet(f"{at}/eval_items.parquet").select("item_id", "item_source")
    return items.join(leaks, "item_id", "left").select(
        "item_id", "item_source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest")
    )


def p6_clean_corpus(spark: SparkSession, at: str) -> DataFrame:
    """Documents that stay when those with leaked passages are removed."""
    docs = spark.read.parquet(f"{at}/documents.parquet")
    return without_leaks(docs, _leaks(spark, at), id_col="doc_id").select("doc_id", "source", "n_chars")


def _mix(spark: SparkSession, at: str) -> Mix:
    docs, targets = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "mix_target"))
    return mix_sources(docs, targets, id_col="doc_id", text_col="text", source_col="source")


def p7_mix(spark: SparkSession, at: str) -> DataFrame:
    """The documents of every mix, a row for each copy."""
    return _mix(spark, at).items.select("mix_name", "doc_id", "copy_no", "source", "tokens")


def p7_shares(spark: SparkSession, at: str) -> DataFrame:
    """What each source was to give to each mix, and gave."""
    return _mix(spark, at).shares


def _levels(spark: SparkSession, at: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "level_label"))
    ranker = fit_ranker(docs, labels, id_col="doc_id", text_col="text", grade_col="grade")
    return reading_levels(docs, ranker, id_col="doc_id", text_col="text")


def p8_level(spark: SparkSession, at: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, at).select("doc_id", F.round("level", 2).alias("level"))


def p8_by_source(spark: SparkSession, at: str) -> DataFrame:
    """How demanding the documents of each source are."""
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", F.lower(F.trim("source")).alias("source"))
    levels = _levels(spark, at).join(docs, "doc_id")
    return levels.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.round(F.avg("level"), 2).alias("mean_level"),
        F.round(F.expr("percentile_approx(level, 0.1)"), 2).alias("easiest_tenth"),
        F.round(F.expr("percentile_approx(level, 0.9)"), 2).alias("hardest_tenth"),
    )


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_sanitised": p2_sanitised, "p3_found": p3_found, "p3_by_source": p3_by_source, "p4_found": p4_found, "p4_consistent_text": p4_consistent_text, "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p6_by_item": p6_by_item, "p6_clean_corpus": p6_clean_corpus, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_level": p8_level, "p8_by_source": p8_by_source}
