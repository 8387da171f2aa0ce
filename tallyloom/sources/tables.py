"""Sources: typed scans of comment tables, and the cleaning before them."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import schemas
from tallyloom.functions.text import NA_TOKENS, na_to_null
from tallyloom.operators.splits import toxicity_union


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, *, na_tokens: tuple[str, ...] = NA_TOKENS, order: str = "src_pos") -> DataFrame:
    """A CSV with a header, quoted texts over several lines and doubled quotes,
    typed by ``schema`` (its columns are found by name, others are skipped).

    Texts that stand for a missing value become null. ``order`` grows with the
    files by path, and with the rows within a file, since later steps ask for the
    first; it has gaps. Texts run over several lines, so a file isn't split: it is
    read by one task. Large tables should come as many files, or as Parquet.
    """
    names = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = names.select(*(F.col(f"`{f.name}`") for f in schema), _file_order(names).alias(order))
    typed = [
        (na_to_null(F.col(f.name), na_tokens) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema
    ]
    return rows.select(*typed, order)


def _file_order(scan: DataFrame) -> Column:
    """Number of a row's file in the order of paths, then its place in the task
    that reads the file (its lower 33 bits)."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    plain = lambda x: F.regexp_replace(x, "^([a-z0-9]+):/+", "$1:/")
    files = sorted(scan.inputFiles())
    if len(files) < 2:
        return place
    paths = F.transform(F.array(*(F.lit(x) for x in files)), plain)
    number = F.array_position(paths, plain(F.col("_metadata.file_path")))
    return F.shiftleft(number - 1, 33) + place


def read_parquet(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """One table of a folder; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def read_comments(spark: SparkSession, path: str, *, labelled: bool) -> DataFrame:
    """The rule-comment table from CSV, with or without labels."""
    return read_csv(spark, path, schemas.TRAIN if labelled else schemas.TEST)


def read_toxicity(spark: SparkSession, data2_pos: str, data2_neg: str, data3_pos: str, data3_neg: str) -> DataFrame:
    """The four toxicity files as one table; see toxicity_union."""
    paths = ((data2_pos, schemas.DATA2), (data2_neg, schemas.DATA2), (data3_pos, schemas.DATA3), (data3_neg, schemas.DATA3))
    return toxicity_union(*(read_csv(spark, path, schema) for path, schema in paths))


def toxicity_paths(folder: str = "Data") -> tuple[str, str, str, str]:
    """Where the four toxicity files are by default."""
    return tuple(os.path.join(folder, f"Data{n}", f"data{n}_{side}.csv") for n in (2, 3) for side in ("positive", "negative"))


def read_head(spark: SparkSession, path: str, *, by_class: bool = False) -> DataFrame:
    """class_id, w: a model head's weights, a row per class. Parquet has them in
    that form; a NumPy file (.npy) as a matrix, hidden size by classes or, with
    ``by_class``, classes by hidden size."""
    if not path.endswith(".npy"):
        return spark.read.schema(schemas.HEAD).parquet(path)
    matrix = np.load(path.removeprefix("file://"), allow_pickle=False)
    if matrix.ndim != 2:
        raise ValueError(f"a matrix is needed, not {matrix.ndim} dimensions")
    rows = matrix if by_class else matrix.T
    return spark.createDataFrame([(k, [float(x) for x in w]) for k, w in enumerate(rows)], schemas.HEAD)


def read_phrasings(spark: SparkSession, path: str) -> DataFrame:
    """rule, variant_no, text: the wordings that a rule may be given by in a
    prompt, numbered from 0 in their order. ``path``: Parquet with rule and text
    and, where the order matters, variant_no. Null and repeated wordings drop out."""
    df = spark.read.parquet(path)
    number = F.col("variant_no") if "variant_no" in df.columns else F.lit(0)
    rows = df.select(F.trim("rule").alias("rule"), "text", number.alias("no")).where("rule is not null and text is not null")
    first = rows.groupBy("rule", "text").agg(F.min("no").alias("no"))
    # a rule has few wordings
    listed = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("all"))
    return listed.select("rule", F.posexplode("all").alias("variant_no", "x")).select("rule", "variant_no", "x.text")


def attach_labels(comments: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Comments with their labels; a label of -1 means unlabelled and drops."""
    return comments.join(labels, key).where(F.col(label) != -1)


def fold_scores(df: DataFrame, into: str, *parts: str) -> DataFrame:
    """One score column, the greatest of several; null only if all are."""
    return df.withColumn(into, F.greatest(*parts)).drop(*(p for p in parts if p != into))


def by_polarity(df: DataFrame, scores: tuple[str, ...], threshold: float = 0.0) -> DataFrame:
    """The column polarity: positives where any score is over the threshold."""
    over = lambda c: F.coalesce((F.col(c) > threshold) & ~F.isnan(c), F.lit(False))
    any_over: Column = F.lit(False)
    for c in scores:
        any_over = any_over | over(c)
    return df.withColumn("polarity", F.when(any_over, "positives").otherwise("negatives"))
