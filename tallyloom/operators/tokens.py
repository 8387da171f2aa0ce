"""Tokens and vocabularies: encoding, used ids, dense remapping, gathering."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import sanitized
from tallyloom.operators.ordering import global_rank

#: A public byte-level BPE vocabulary in tiktoken's form.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are cut before pairs are merged.
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most ids of a vocabulary that every task gets a copy of (16 bytes each).
MOST_HELD = 4_000_000


class Tokenizer(Protocol):
    """What the prompt and vocabulary operators need of a tokenizer."""

    def ids(self, text: Column) -> Column:
        """array<int>; null for null."""

    def constant(self, text: str) -> Column:
        """The ids of a text that is the same in all rows."""

    def length(self, text: Column) -> Column:
        """Number of ids; null for null."""


def _lists(like: pa.Array, values: pa.Array | np.ndarray, lengths: pa.Array) -> pa.Array:
    """Lists of the given lengths, null where ``like`` is."""
    ends = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=like.is_null())


class ByteTokenizer:
    """One id per byte of UTF-8, from whole Arrow buffers at a time."""

    def ids(self, text: Column) -> Column:
        def run(texts: pa.Array) -> pa.Array:
            texts = texts.cast(pa.large_binary())
            data, ends = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
            return _lists(texts, held.astype(np.int32), pc.binary_length(texts))

        return F.arrow_udf(run, "array<int>")(text)

    def constant(self, text: str) -> Column:
        return F.array(*(F.lit(x) for x in text.encode()))

    def length(self, text: Column) -> Column:
        return F.octet_length(text)


class WordTokenizer:
    """Hashed ids of the pieces between blanks, in the JVM."""

    def __init__(self, size: int = 1 << 20) -> None:
        self.size = size

    def pieces(self, text: Column) -> Column:
        return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")

    def ids(self, text: Column) -> Column:
        return F.transform(self.pieces(text), lambda x: F.pmod(F.xxhash64(x), F.lit(self.size)).cast("int"))

    def constant(self, text: str) -> Column:
        return self.ids(F.lit(text))

    def length(self, text: Column) -> Column:
        return F.size(self.pieces(text))


class PublicTokenizer:
    """A byte-level BPE vocabulary in tiktoken's form, a batch at a time."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
        self.pattern = pattern

    def ids(self, text: Column) -> Column:
        ranks, pattern = self.ranks, self.pattern

        def run(batches):
            import tiktoken

            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for texts in batches:
                yield texts.map(encoding.encode_ordinary, na_action="ignore")

        # the kind of UDF is read from the annotations
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<int>")(text)

    def constant(self, text: str) -> Column:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return F.array(*(F.lit(x) for x in encoding.encode_ordinary(text)))

    def length(self, text: Column) -> Column:
        return F.size(self.ids(text))


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """Rows whose text has content, stripped, with its ids. Null, blank,
    "nan" and "none" texts drop out, so positions may have gaps."""
    kept = df.withColumn(text, sanitized(text)).where(F.col(text).isNotNull())
    return kept.withColumn(ids, tokenizer.ids(F.col(text)))


def tokenize_pools(items: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """pool_id, pos, ids: every pool once, however many rules refer to it;
    positions are dense again."""
    coded = encode(items, tokenizer).withColumnRenamed("pos", "old_pos")
    return global_rank(coded, ["pool_id"], ["old_pos"]).select("pool_id", "pos", "ids")


def used_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """old_id: every id that occurs, once; no row for no ids."""
    return df.select(F.explode(F.array_distinct(ids)).alias("old_id")).distinct()


def vocab_map(used: DataFrame) -> DataFrame:
    """old_id, new_id: places of the used ids in their order, from 0. Other
    ids are to become the number of rows."""
    return global_rank(used.where("old_id is not null"), [], ["old_id"], "new_id").select("old_id", "new_id")


def remap(df: DataFrame, vocab: DataFrame, key: list[str], ids: str = "ids", *, most: int = MOST_HELD) -> DataFrame:
    """key, ids: each list with its ids replaced, unknown ones by the size of
    the vocabulary. Empty lists stay empty and null lists null; null ids are
    unknown.

    A vocabulary of up to ``most`` ids goes to every task and lists are replaced
    where they are. A larger one is joined, which moves every token; ``key`` must
    identify a row then.
    """
    size = vocab.count()
    if size > most:
        return _remap_by_join(df, vocab, key, ids)
    held = vocab.select(F.col("old_id").cast("long"), F.col("new_id").cast("long")).orderBy("old_id").toArrow()
    old, new = (np.append(held.column(k).to_numpy(), last).astype(np.int64) for k, last in ((0, np.iinfo(np.int64).max), (1, size)))

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        values = flat.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        at = np.searchsorted(old, values)
        return _lists(lists, np.where(old[at] == values, new[at], size), pc.list_value_length(lists))

    return df.select(*key, F.arrow_udf(run, "array<bigint>")(F.col(ids)).alias(ids))


def _remap_by_join(df: DataFrame, vocab: DataFrame, key: list[str], ids: str) -> DataFrame:
    size = vocab.agg(F.count("*").alias("oov"))
    each = df.select(*key, F.posexplode(ids).alias("at", "old_id"))
    found = each.join(vocab, "old_id", "left").join(F.broadcast(size)).withColumn("new_id", F.coalesce("new_id", "oov"))  # size is one row
    lists = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "new_id"))).alias("__new"))
    out = df.select(*key, F.col(ids).alias("__old")).join(lists, key, "left")
    new = F.coalesce(F.transform("__new", lambda x: x["new_id"]), F.when(F.col("__old").isNotNull(), F.array().cast("array<bigint>")))
    return out.select(*key, new.alias(ids))


def gather(vocab: DataFrame, matrix: DataFrame, row_id: str, vector: str) -> DataFrame:
    """new_id, vec: the rows of a matrix that the vocabulary keeps."""
    return vocab.join(matrix.select(F.col(row_id).alias("old_id"), F.col(vector).alias("vec")), "old_id").select("new_id", "vec")


def mean_vector(matrix: DataFrame, vector: str) -> DataFrame:
    """dim, mean: the mean of each column, as a row for unknown ids."""
    return matrix.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
