"""Records that stand in two splits, exactly or almost: content-defined chunks.

Every record is normalised to its words and cut into chunks where a rolling
hash over ``WINDOW`` words says so; an edit changes only the chunks it touches.
Chunk digests are joined across the splits. Of each record, the rarest digests
take part, down to where what is left could not make up ``LEAST_SHARED`` of
its length: two records with that much of their chunks in common share one of
these. The lengths of all shared chunks, summed, give each pair's overlap
fraction; the pairs are then checked word by word.

Chunks depend on the order of the words, so records are one only if their words
are the same in the same order. The word check doesn't: where one order of a bag
of words is to be looked at, all orders of it are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import setjoin as sj
from tallyloom.llm.textform import bags, coded_words, hash_words, mix, sums
from tallyloom.storage import materialise, shuffle_width

#: Words that the rolling hash looks at; a chunk ends at one place in CUT_EVERY,
#: after LONGEST words at the latest.
WINDOW, CUT_EVERY, LONGEST = 2, 3, 64
#: Share of the longer record that the chunks in common must make up for a pair
#: to be looked at.
LEAST_SHARED = 0.2
#: As in near_copies: a digest is common if it stands in this share of records.
COMMON = 1 / 1000
#: Records of a digest beyond which they are spread over several keys: each of
#: the other side takes one of them, each held-out one all.
SPREAD = 50_000


@dataclass(frozen=True)
class SplitOverlap:
    """members: held (is it the held-out side), field, id, uid. pairs:
    uid_held, uid_other, shared_chunks (fraction of the longer record)."""

    members: DataFrame
    pairs: DataFrame

    def rows(self) -> DataFrame:
        """held_id, other_id, field, shared_chunks: one row per pair of rows."""
        m = self.members
        held = m.where("held").select(F.col("uid").alias("uid_held"), F.col("id").alias("held_id"))
        other = m.where("not held").select(F.col("uid").alias("uid_other"), F.col("id").alias("other_id"), "field")
        return self.pairs.join(held, "uid_held").join(other, "uid_other").select("held_id", "other_id", "field", "shared_chunks")


def chunks(ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and length of the chunks of all records in a row."""
    count = np.diff(ends)
    owner = np.repeat(np.arange(len(count)), count)
    if not len(hashes):
        return owner, hashes, owner
    rolling = hashes.copy()
    for back in range(1, WINDOW):
        rolling[back:] = mix(rolling[back:]) + hashes[:-back]
    place = np.arange(len(hashes)) - ends[owner]
    cut = (mix(rolling) % np.uint64(CUT_EVERY) == 0) & (place >= WINDOW - 1)
    cut |= place == count[owner] - 1
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    if (last - first >= LONGEST).any():
        start = np.repeat(first, last - first + 1)
        cut |= (np.arange(len(hashes)) - start) % LONGEST == LONGEST - 1
        last = np.flatnonzero(cut)
        first = np.concatenate([[0], last[:-1] + 1])
    length = last - first + 1
    start = np.repeat(first, length)
    inner = (np.arange(len(hashes)) - start).astype(np.uint64)
    digest = mix(sums(np.concatenate([[0], last + 1]), mix(hashes + inner * np.uint64(0xD6E8FEB86659FD93))))
    return owner[last], digest, length


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


_CODED = "held boolean, field string, id long, n int, one long, two long, ordered long, words array<long>, pieces array<long>"


def _encoder(min_words: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").dictionary_encode()
            which = texts.indices.to_numpy()
            ends, codes, unique = coded_words(texts.dictionary.to_pylist())
            hashes = hash_words(unique)
            values, one, two = bags(ends, codes, hashes)
            n = np.diff(ends)
            place = (np.arange(len(codes)) - np.repeat(ends[:-1], n)).astype(np.uint64)
            ordered = sums(ends, mix(hashes[codes] + place * np.uint64(0xD6E8FEB86659FD93)))
            owner, digest, length = chunks(ends, hashes[codes])
            # a chunk that recurs in a record is another piece each time; the
            # last byte of a piece is its length
            piece_ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            names, number = np.unique(digest, return_inverse=True)
            span = np.zeros(len(names), np.uint64)
            span[number] = length
            pieces, _, _ = bags(piece_ends, number, (names & ~np.uint64(0xFF)) | span)
            by = np.sort((np.repeat(np.arange(len(n)), np.diff(piece_ends)) << 32) | number)
            pieces = (pieces & ~np.uint64(0xFF)) | span[by & 0xFFFFFFFF]
            keep = n[which] >= min_words
            # words and pieces go with the first row of each text only
            first = np.zeros(len(which), bool)
            first[np.unique(which, return_index=True)[1]] = True
            which, first = which[keep], first[keep]

            def column(ends: np.ndarray, x: np.ndarray, which=which, first=first) -> pa.Array:
                m = np.where(first, np.diff(ends)[which], 0)
                to = np.concatenate([[0], np.cumsum(m)])
                return _lists(to, x[np.arange(to[-1]) - np.repeat(to[:-1], m) + np.repeat(ends[which], m)].view(np.int64))

            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("held").filter(rows), batch.column("field").filter(rows), batch.column("id").filter(rows),
                    pa.array(n[which].astype(np.int32)), pa.array(one[which].view(np.int64)), pa.array(two[which].view(np.int64)),
                    pa.array(ordered[which].view(np.int64)), column(ends, values), column(piece_ends, pieces),
                ],
                ["held", "field", "id", "n", "one", "two", "ordered", "words", "pieces"],
            )

    return encode


def _keys(common: np.ndarray, counts: np.ndarray, least_shared: float = LEAST_SHARED):
    """common: digests in the order of their frequency, with it. The ids of the
    rows are those of bags: a sum that two bags share costs a word check only."""
    order = np.argsort(common)
    ordered = common[order]
    shares = -(-counts // SPREAD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, bag, held = batch.column("uid").to_numpy(), batch.column("one").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy().astype(np.int64)
            ends = batch.column("words").offsets.to_numpy().astype(np.int64)
            values = batch.column("words").values.to_numpy()[ends[0] : ends[-1]]
            bits = sj.sketches(np.repeat(np.arange(len(n)), np.diff(ends)), values.view(np.uint64), len(n))
            ends = batch.column("pieces").offsets.to_numpy().astype(np.int64)
            pieces = batch.column("pieces").values.to_numpy()[ends[0] : ends[-1]]
            owner = np.repeat(np.arange(len(n)), np.diff(ends))
            at = np.minimum(np.searchsorted(ordered, pieces), max(len(ordered) - 1, 0))
            rank = np.where(ordered[at] == pieces, order[at] + 1, 0) if len(ordered) else np.zeros(len(pieces), np.int64)
            by = np.lexsort((pieces, rank, owner))
            owner, pieces = owner[by], pieces[by]
            length = pieces & 0xFF
            before = np.cumsum(length) - length
            before -= before[np.searchsorted(owner, np.arange(len(n)))[owner]] if len(owner) else 0
            own = n[owner] - before >= least_shared * n[owner]
            owner, pieces, rank = owner[own], pieces[own], rank[by][own]
            times = np.where(rank > 0, shares[np.maximum(rank - 1, 0)], 1) if len(shares) else np.ones(len(pieces), np.int64)
            every = np.where(held[owner], times, 1)
            first = np.repeat(np.cumsum(every) - every, every)
            share = np.where(np.repeat(held[owner], every), np.arange(int(every.sum())) - first, np.repeat(uid[owner] % times, every))
            owner, pieces = np.repeat(owner, every), np.repeat(pieces, every)
            spread = mix(pieces.view(np.uint64) + share.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            pieces = np.where(share > 0, spread, pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces), pa.array(bag[owner]), pa.array(held[owner]), pa.array(n[owner].astype(np.int32)), sj.fixed_binary(bits[owner])],
                ["key", "id", "held", "n", "bits"],
            )

    return rows


def _candidates(permille: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sj.blocks_by_key(batches):
            group = sj.group_numbers(table.column("key").to_numpy())
            n = table.column("n").to_numpy().astype(np.int64)
            uid = table.column("id").to_numpy()
            side = 1 - table.column("held").to_numpy().astype(np.int64)
            bits = sj.as_words(table.column("bits"))
            found = [np.empty((0, 2), np.int64)]
            for i, j in sj.pairs_across(group, n, side, permille):
                ok = sj.may_match(i, j, n, bits, permille)
                found.append(np.stack([uid[i[ok]], uid[j[ok]]], axis=1))
            each = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0].copy()), pa.array(each[:, 1].copy())], ["a", "b"])

    return pairs


def split_overlap(
    held: DataFrame, other: DataFrame, *, threshold: float = 0.7, min_words: int = 12, least_shared: float = LEAST_SHARED
) -> SplitOverlap:
    """Near-same records of a held-out split and of another.

    Both sides have the columns id (bigint), field and text; (field, id) is
    unique, and a row that comes twice counts once. Near-same is as in
    ``near_copies``. Null, blank and shorter texts overlap with nothing. Pairs
    that share less than ``least_shared`` of the longer record's chunks are not
    looked at; with 0, all that share any chunk are.
    """
    permille = round(threshold * 1000)
    spark = held.sparkSession
    one_side = lambda df, x: df.select(F.lit(x).alias("held"), F.col("field").cast("string"), F.col("id").cast("long"), "text")
    texts = one_side(held, True).unionByName(one_side(other, False)).where("id is not null and text is not null")
    coded = materialise(texts.mapInArrow(_encoder(min_words), _CODED), "pieces")
    key = ["held", "one", "two", "ordered"]
    records = materialise(
        coded.where(F.size("words") > 0)
        .groupBy(*key)
        .agg(F.first("n").alias("n"), F.first("words").alias("words"), F.first("pieces").alias("pieces"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "records",
    )
    members = coded.select(*key, "field", "id").distinct().join(records.select(*key, "uid"), key).select("held", "field", "id", "uid")

    counts = records.select(F.explode("pieces").alias("piece")).groupBy("piece").count()
    # bounded: at most (mean pieces of a record) / COMMON digests
    common = counts.where(F.col("count") >= max(2.0, COMMON * records.count())).collect()
    common.sort(key=lambda x: (x["count"], x.piece))
    found = (
        records.mapInArrow(_keys(*(np.asarray([x[k] for x in common], np.int64) for k in ("piece", "count")), least_shared), "key long, id long, held boolean, n int, bits binary")
        .repartition(shuffle_width(spark), "key")
        .sortWithinPartitions("key", "held", "n")
        .mapInArrow(_candidates(permille), "a long, b long")
        .distinct()
    )
    side = lambda held, x: records.where(held).select(
        F.col("one").alias(x), F.col("uid").alias(f"uid_{x}"), F.col("n").alias(f"n_{x}"), F.col("words").alias(f"words_{x}"), F.col("pieces").alias(f"pieces_{x}")
    )
    both = found.join(side("held", "a"), "a").join(side("not held", "b"), "b")
    longer = F.greatest("n_a", "n_b")
    lengths = F.aggregate(F.array_intersect("pieces_a", "pieces_b"), F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(255)))
    pairs = both.where(F.size(F.array_intersect("words_a", "words_b")) * 1000 >= longer * permille).select(
        F.col("uid_a").alias("uid_held"), F.col("uid_b").alias("uid_other"), (lengths / longer).alias("shared_chunks")
    )
    return SplitOverlap(members, materialise(pairs, "overlaps"))
