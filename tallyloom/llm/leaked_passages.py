"""Passages of held-out items in a corpus: suffix arrays over its shards.

The corpus is cut into shards of whole documents. Each shard's words become
numbers, its suffixes are sorted, and every suffix of every item is looked up
by binary search. Where at least ``min_words`` words agree, the match is
followed to its full length. Items are packed into blocks by their running size,
so the number of items is not limited by memory: each block is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textform import words
from tallyloom.operators.ordering import running_total
from tallyloom.storage import materialise

#: Characters of item text that are sent to every task at a time; the item that
#: reaches them is sent whole.
BLOCK_CHARS = 8_000_000
#: Words of a shard, and characters of text that are split into words at a time.
SHARD_WORDS, SLICE_CHARS = 3_000_000, 1_000_000
#: Most words that are packed into one number of 63 bits.
PACK = 3


def _pack(different: int) -> int:
    """How many words of so many different ones a number can hold."""
    return PACK if different < 1 << 63 // PACK else 2


def _packed(ids: np.ndarray, pack: int) -> np.ndarray:
    """Each place's word and those behind it as one number."""
    wide = np.concatenate([ids.astype(np.int64), np.zeros(pack, np.int64)])
    out = wide[: len(ids)].copy()
    for x in range(1, pack):
        out = (out << 63 // pack) | wide[x : x + len(ids)]
    return out


def _runs(ids: np.ndarray) -> np.ndarray:
    """Number of known words from each place on."""
    at = np.arange(len(ids))
    stop = np.where(ids == 0, at, len(ids))
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def suffix_array(ids: np.ndarray, depth: int, least: int, pack: int = PACK) -> np.ndarray:
    """Places in the order of the words that follow, as far as ``depth``
    words; places with fewer than ``least`` known words are left out.
    The rank of a place doubles its reach in each round."""
    places = np.flatnonzero(_runs(ids) >= least)
    rank = np.zeros(len(ids) + depth + pack, np.int64)
    every = _packed(ids, pack)
    inner = np.flatnonzero(ids)
    rank[inner] = np.unique(every[inner], return_inverse=True)[1] + 1
    reach = pack
    while reach < depth:
        key = (rank[places] << 32) | rank[places + reach]
        if reach * 2 >= depth:
            return places[np.argsort(key, kind="stable")]
        key = (rank[inner] << 32) | rank[inner + reach]
        rank[inner] = np.unique(key, return_inverse=True)[1] + 1
        reach *= 2
    return places[np.argsort(rank[places], kind="stable")]


def _bound(suffixes: np.ndarray, corpus: np.ndarray, sought: np.ndarray, starts: np.ndarray, steps: list[int], right: bool) -> np.ndarray:
    """Binary search of all sought places at once, by the words at steps."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(suffixes), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = suffixes[np.minimum(mid, len(suffixes) - 1)]
        less, tied = np.zeros(len(starts), bool), np.ones(len(starts), bool)
        for step in steps:
            a, b = corpus[at + step], sought[starts + step]
            less |= tied & (a < b)
            tied &= a == b
        up = open_ & (less | (tied & right))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def matches(ids: np.ndarray, sought: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the shard, place in the items and length of every longest
    common passage of ``least`` words or more. 0 stands for no word."""
    pack = _pack(int(sought.max(initial=0)))
    starts = np.flatnonzero(_runs(sought) >= least)
    suffixes = suffix_array(ids, -(-least // pack) * pack, least, pack)
    if not len(starts) or not len(suffixes):
        return (np.empty(0, np.int64),) * 3
    steps = [*range(0, least - pack + 1, pack)]
    if steps[-1] + pack < least:
        steps.append(least - pack)
    corpus, wanted = _packed(ids, pack), _packed(sought, pack)
    low = _bound(suffixes, corpus, wanted, starts, steps, False)
    count = _bound(suffixes, corpus, wanted, starts, steps, True) - low
    own = np.repeat(np.arange(len(starts)), count)
    p = suffixes[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]]
    q = starts[own]
    # a passage counts once, from its first word on
    begins = (p == 0) | (q == 0)
    begins |= (ids[p - 1] != sought[q - 1]) | (ids[p - 1] == 0)
    p, q = p[begins], q[begins]
    length = np.full(len(p), least, np.int64)
    end_p, end_q = np.append(ids, 0), np.append(sought, 0)
    grow = np.arange(len(p))
    while len(grow):
        a, b = end_p[p[grow] + length[grow]], end_q[q[grow] + length[grow]]
        grow = grow[(a == b) & (a != 0)]
        length[grow] += 1
    return p, q, length


def _search(items: list[tuple[int, str]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        parts, owner = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for k, (_, text) in enumerate(items):
            w = words(text)
            parts.append(np.fromiter((index.setdefault(x, len(index) + 1) for x in w), np.int64, len(w)))
            parts.append(np.zeros(1, np.int64))
            owner.append(np.full(len(w) + 1, k))
        sought, owner = np.concatenate(parts), np.concatenate(owner)
        item_ids = np.asarray([i for i, _ in items], np.int64)
        first = np.searchsorted(owner[1:], np.arange(len(items))) + 1
        get = index.get
        shard: list[np.ndarray] = []
        docs: list[int] = []
        ends: list[int] = []
        held = 0

        def look() -> pa.RecordBatch:
            ids = np.concatenate(shard)
            p, q, length = matches(ids, sought, least)
            stop = np.asarray(ends)
            doc = np.searchsorted(stop, p, "right")
            begin = np.concatenate([[0], stop[:-1]])
            item = owner[q]
            columns = [np.asarray(docs, np.int64)[doc], item_ids[item], p - begin[doc], q - first[item], length]
            shard.clear(), docs.clear(), ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                w = words(text.as_py())
                if len(w) < least:
                    continue
                shard.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                shard.append(np.zeros(1, np.int64))
                held += len(w) + 1
                docs.append(doc)
                ends.append(held)
                if held >= SHARD_WORDS:
                    yield look()
                    held = 0
        if docs:
            yield look()

    return run


def leaked_passages(corpus: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str, min_words: int = 12) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: every longest passage of
    ``min_words`` consecutive words or more that a document and an item share;
    the positions count words from 0.

    Null and shorter texts on either side share nothing. Other columns are
    ignored. Documents and items delivered twice give their rows once.
    """
    if min_words < PACK:
        raise ValueError(f"min_words must be {PACK} or more")
    docs = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    held = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null").distinct()
    held = materialise(held, "items")
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > BLOCK_CHARS:
        held = materialise(running_total(held.withColumn("chars", F.length("text")), ["id", "text"], "chars", "before"), "blocks")
    else:
        held = held.withColumn("before", F.lit(0))
    out = None
    for k in range(size // BLOCK_CHARS + 1):
        block = [(x.id, x.text) for x in held.where(F.floor(F.col("before") / BLOCK_CHARS) == k).collect()]
        found = docs.mapInArrow(_search(block, min_words), "doc_id long, item_id long, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def without_leaks(corpus: DataFrame, leaks: DataFrame, *, id_col: str) -> DataFrame:
    """The documents of ``corpus`` that hold no passage of ``leaks``."""
    return corpus.join(leaks.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
