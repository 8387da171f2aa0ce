"""Mixing sources to target weights: weighted fair queueing.

The documents of each source stand in a shuffled queue. A document's virtual
finish time is the tokens of its source up to and including it, divided by the
source's target weight; a repeated pass over a small source goes on counting
where the pass before ended. Sorted by finish time over all sources, every
beginning of the list holds the sources in their target shares; it is cut at
the mix's budget of tokens. Running totals are taken over range partitions, so
that one source may hold any part of all documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.storage import materialise, shuffle_width

#: A public byte-level BPE vocabulary in tiktoken's form.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are cut before pairs are merged.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Mix:
    """items: mix_name, doc_id, copy_no, source, tokens, finish_time, in the
    mixes; shares: what each source was to give and gave."""

    items: DataFrame
    shares: DataFrame


def token_counts(df: DataFrame, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text but with the column tokens; 0 for null texts."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())  # a file of fixed size
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in held.value.splitlines() if x)}
        encoding = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(x)) if x else 0 for x in (y.as_py() for y in batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sizes, pa.int64())], [*rest, "tokens"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(rest).dtypes)
    return df.select(*rest, text_col).mapInArrow(run, f"{kinds}, tokens long")


def running_totals(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the column running: the sum of ``value`` up to and including
    the row, by ``group``, in ``order`` (which must be unique in a group).

    Range partitions are summed apart and then offset by the sums of those
    before them: no task holds a whole group.
    """
    columns = df.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(group).dictionary_encode().indices.to_numpy()
            first = batch.column(group)[0].as_py()
            sums = np.cumsum(batch.column(value).to_numpy())
            new = np.ones(len(sums), bool)
            new[1:] = codes[1:] != codes[:-1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(sums)), 0))
            base = np.where(at > 0, sums[np.maximum(at - 1, 0)], 0)
            local = sums - base
            if first == last:
                local[at == 0] += total
            last, total = batch.column(group)[-1].as_py(), int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(len(sums), part, np.int32))], [*columns, "local", "part"])

    spread = df.repartitionByRange(shuffle_width(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    summed = materialise(spread.mapInArrow(run, f"{kinds}, local long, part int"), name)
    # a line for each group in each partition; ranges meet only at their ends
    lines = summed.groupBy("part", group).agg(F.max("local").alias("whole"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("part", group, F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("offset"))
    return summed.join(lines, ["part", group]).select(*columns, (F.col("local") + F.col("offset")).alias("running"))


def _plain_source(column: str):
    return F.lower(F.trim(column))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str,
    text_col: str,
    source_col: str,
    vocabulary: str = VOCABULARY,
    seed: int = 42,
) -> Mix:
    """Mixes of documents in which each source has its target share of tokens.

    ``targets``: mix_name, source, target_share, max_repeats, size_factor. A
    mix has size_factor times all tokens of ``docs``; a source is to give
    target_share of that, by repeating its documents at most max_repeats times.
    What a source can't give is not made up for by others. Sources are compared
    without case and outer blanks; documents without a source, with one that a
    mix doesn't name, or without tokens are in no mix. Of a document that comes
    several times one counts: with a source, then the first of these, then the
    longest. Rows without an id are one document. A target without a
    share above 0 and max_repeats of 1 or more gives nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _plain_source(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = token_counts(rows, "text", vocabulary)
    once = counted.groupBy("doc_id").agg(F.min(F.struct(F.col("source").isNull().alias("unknown"), "source", (-F.col("tokens")).alias("less"))).alias("x"))
    sizes = materialise(once.select("doc_id", "x.source", (-F.col("x.less")).alias("tokens")), "sizes")
    supply = sizes.groupBy("source").agg(F.sum("tokens").alias("supply"))
    every = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = (
        targets.select("mix_name", _plain_source("source").alias("source"), "target_share", "max_repeats", "size_factor")
        .where("mix_name is not null")
        .join(supply, "source", "left")
        .withColumn("supply", F.coalesce("supply", F.lit(0)))
        .withColumn("mix_size", F.col("size_factor") * every)
        .withColumn("target_tokens", F.when(F.col("target_share") > 0, F.col("target_share") * F.col("mix_size")).otherwise(0.0))
        .withColumn("quota", F.least("target_tokens", F.col("supply") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))))
    )
    wanted = wanted.withColumn("budget", F.sum("quota").over(Window.partitionBy("mix_name")))
    wanted = wanted.withColumn("passes", F.ceil(F.col("quota") / F.nullif("supply", F.lit(0))).cast("int"))

    queue = sizes.where("tokens > 0 and source is not null").withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    queue = running_totals(queue, "source", ["place", "doc_id"], "tokens", "queue")
    lined = (
        queue.join(wanted.where("passes > 0"), "source")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), "passes")))
        .withColumn("given", (F.col("copy_no") - 1) * F.col("supply") + F.col("running"))
        # what starts after the source's quota can't finish within the budget
        .where(F.col("given") - F.col("tokens") < F.col("quota"))
        .withColumn("finish_time", F.col("given") / F.col("target_share"))
        .select("mix_name", "doc_id", "copy_no", "source", "tokens", "budget", "finish_time")
    )
    ranked = running_totals(lined, "mix_name", ["finish_time", "doc_id", "copy_no"], "tokens", "ranked")
    items = ranked.where(F.col("running") <= F.col("budget")).select("mix_name", "doc_id", "copy_no", "source", "tokens", "finish_time")

    given = items.groupBy("mix_name", "source").agg(
        F.sum("tokens").alias("actual_tokens"), F.count("*").alias("n_items"), F.max("copy_no").alias("most_copies")
    )
    shares = wanted.join(given, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.col("target_tokens").cast("long").alias("target_tokens"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("actual_tokens", "n_items", "most_copies")), "mix_size",
    )
    total = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    ratio = lambda whole: F.coalesce(F.col("actual_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0))
    shares = shares.withColumns({"actual_share": ratio(total), "share_of_size": ratio(F.col("mix_size"))}).drop("mix_size")
    return Mix(items, shares)
