"""Near-duplicate records: similarity join by adaptive multi-match prefixes.

Every text becomes the set of its words, a repeated word counting as often as
it occurs. Words are put in one global order, rare ones first. If two texts
are near-same, their first k common words stand within the first t+k words of
both, where t is the number of words either may lose. So

* each word of the first t+1 keys one row of a document (its prefix);
* the rows of one key meet in one group. A small group compares all its rows
  by size and bitmap. In a large group, that is where a single common word
  would let through too many candidates, the prefix is lengthened: by as many
  further words as the estimated number of candidates calls for, and only
  documents that share all of these words are compared;
* a key that is too frequent for one task is split by the next word of the
  prefix before the shuffle, the parts that are still too frequent by one more
  word, and so on. What shares even the last word that is tried is cut into
  blocks, and every two blocks meet in a task of their own.

So no task holds more rows of a key than ``SPLIT_GROUP``, and no pair is lost by any of this. Documents with equal bags of words are one
class; classes are compared, then checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import setjoin as sj
from tallyloom.llm.textform import bags, coded_words, hash_words, mix
from tallyloom.storage import materialise, shuffle_width

#: A word is common if it stands in this share of the texts. There are at most
#: (mean words of a text) / COMMON of them, whatever the size of the input.
COMMON = 1 / 1000
#: Most words that rows of a group are matched by, the key of one word included;
#: a key of several words is followed by as many further ones.
DEEPEST = 4
#: Rows up to which a group is compared row by row; rows of a key beyond which it
#: is split by the next word.
SMALL_GROUP, SPLIT_GROUP = 400, 250_000
#: Most words of a key. Rows that share a key of so many words and are too many
#: for one task are cut into blocks of BLOCK_ROWS.
DEEPEST_KEY, BLOCK_ROWS = 4, 100_000
#: Rare words are counted by hash in so many buckets, where some of them might
#: make large groups (a power of 2). A full bucket costs time, never a pair.
BUCKETS = 1 << 20
#: The prefix is lengthened if the candidates cost more than the combinations
#: of words that the next length makes; one of these costs as much as so many
#: candidates.
COMBINATION = 4
#: Combinations that are made at a time; rows that an estimate looks at.
BLOCK_COMBINATIONS, ESTIMATE_ROWS = 1_000_000, 2_000
#: Words in a row's part of the prefix beyond which it is compared by bitmap.
LONG_TAIL = 30


@dataclass(frozen=True)
class NearCopies:
    """members: grp, id, class_id. pairs: class_a < class_b and the common
    part in words; class_id is the smallest id of the class."""

    members: DataFrame
    pairs: DataFrame

    def all_pairs(self) -> DataFrame:
        """grp, id_a < id_b: the pairs of rows, copies of one text included."""
        m = self.members
        side = lambda x: m.select("grp", F.col("class_id").alias(f"class_{x}"), F.col("id").alias(x))
        links = self.pairs.join(side("a"), ["grp", "class_a"]).join(side("b"), ["grp", "class_b"])
        links = links.select("grp", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        several = m.where("copies > 1")
        copies = (
            several.select("grp", "class_id", F.col("id").alias("id_a"))
            .join(several.select("grp", "class_id", F.col("id").alias("id_b")), ["grp", "class_id"])
            .where("id_a < id_b")
            .select("grp", "id_a", "id_b")
        )
        return links.unionByName(copies)

    def links(self) -> DataFrame:
        """grp, id, class_id, copies, links: every row with the number of rows
        of its class and of other rows that are near-same to it."""
        sizes = self.members.groupBy("grp", "class_id").agg(F.count("*").alias("copies"))
        both = self.pairs.select("grp", F.col("class_a").alias("mine"), F.col("class_b").alias("class_id"))
        both = both.unionByName(self.pairs.select("grp", F.col("class_b").alias("mine"), F.col("class_a").alias("class_id")))
        near = both.join(sizes, ["grp", "class_id"]).groupBy("grp", F.col("mine").alias("class_id")).agg(F.sum("copies").alias("near"))
        classes = sizes.join(near, ["grp", "class_id"], "left").withColumn("links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)))
        return self.members.select("grp", "id", "class_id").join(classes.select("grp", "class_id", "copies", "links"), ["grp", "class_id"]).select(
            "grp", "id", "class_id", "copies", "links"
        )


def _hashed(texts: pa.Array, groups: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and numbers of the words of each text, and the two sums. Texts
    of different groups have no number in common."""
    ends, codes, unique = coded_words(texts.to_pylist())
    values, one, two = bags(ends, codes, hash_words(unique))
    salt = {g: hash_words([str(g)], 7)[0] for g in groups.unique().to_pylist()}
    own = np.asarray([salt[g] for g in groups.to_pylist()], np.uint64)
    return ends, mix(values ^ np.repeat(own, np.diff(ends))), one, two


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words that are common in this part of the texts. A word
    that is common in all texts is common in one part at least."""
    for batch in batches:
        _, values, _, _ = _hashed(batch.column("text"), batch.column("grp"))
        word, count = np.unique(values.view(np.int64), return_counts=True)
        keep = count >= max(2.0, COMMON * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(word[keep]), pa.array(count[keep])], ["word", "n"])


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _encoder(common: np.ndarray, min_words: int):
    """common: hashes in the order of their frequency, rare first."""
    order = np.argsort(common)
    ordered = common[order]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values, one, two = _hashed(batch.column("text"), batch.column("grp"))
            n = np.diff(ends)
            owner = np.repeat(np.arange(len(n)), n)
            values = values.view(np.int64)
            at = np.minimum(np.searchsorted(ordered, values), max(len(ordered) - 1, 0))
            known = ordered[at] == values if len(ordered) else np.zeros(len(values), bool)
            long = n >= min_words
            kept = long[owner]

            def column(chosen: np.ndarray, x: np.ndarray) -> pa.Array:
                o, x = owner[chosen], x[chosen]
                x = x[np.lexsort((x, o))]
                return _lists(np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(n))[long])]), x)

            rows = pa.array(long)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grp").filter(rows),
                    batch.column("id").filter(rows),
                    pa.array(one[long].view(np.int64)),
                    pa.array(two[long].view(np.int64)),
                    column(~known & kept, values),
                    column(known & kept, order[at].astype(np.int32) if len(ordered) else np.zeros(len(values), np.int32)),
                ],
                ["grp", "id", "one", "two", "rare", "common"],
            )

    return encode


def _ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def _slices(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of values[start:stop] of every row."""
    n = np.maximum(stop - start, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    return ends, values[np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(start, n)]


_PREFIX = "key long, id long, n int, room int, depth int, bits binary, tail array<int>"


@dataclass(frozen=True)
class Heavy:
    """Numbers of rows of the keys that may be too many for one task: of each
    common word, of the rare words of each bucket (or nothing, where no rare word
    can be in more than SMALL_GROUP rows), and of the keys of two words and more,
    by depth: sorted keys beyond SPLIT_GROUP and their rows."""

    common: np.ndarray
    rare: np.ndarray
    longer: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def words(self, rare: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of_rare = self.rare[rare & (BUCKETS - 1)] if len(self.rare) else np.zeros(len(rare), np.int64)
        return of_rare, self.common[common] if len(common) else np.zeros(0, np.int64)

    def keys(self, depth: int, key: np.ndarray) -> np.ndarray:
        known, rows = self.longer[depth - 2] if depth - 2 < len(self.longer) else (np.empty(0, np.int64),) * 2
        if not len(known):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(known, key.view(np.int64)), len(known) - 1)
        return np.where(known[at] == key.view(np.int64), rows[at], 0)

    def deepest(self) -> bool:
        """Whether some key of the longest kind is still too frequent."""
        if self.longer:
            return len(self.longer[-1][0]) > 0
        return bool((self.common > SPLIT_GROUP).any() or (self.rare > SPLIT_GROUP).any())


@dataclass(frozen=True)
class _Sequences:
    """The words of some rows in their global order, rare ones first."""

    ends: np.ndarray
    key: np.ndarray  # each word as part of a key
    tail: np.ndarray  # each word as part of a tail; below 0 for rare ones
    rows: np.ndarray  # about how many rows have the word, at least if many do
    n: np.ndarray
    need: np.ndarray


def _sequences(batch: pa.RecordBatch, permille: int, heavy: Heavy) -> _Sequences:
    rare_ends, rare = _ends(batch.column("rare"))
    common_ends, common = _ends(batch.column("common"))
    r, c = np.diff(rare_ends), np.diff(common_ends)
    n = r + c
    ends = np.concatenate([[0], np.cumsum(n)])
    at_rare = np.arange(len(rare)) + np.repeat(ends[:-1] - rare_ends[:-1], r)
    at_common = np.arange(len(common)) + np.repeat(ends[:-1] + r - common_ends[:-1], c)
    key, tail, rows = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int64)
    key[at_rare], key[at_common] = rare.view(np.uint64), mix(common.astype(np.uint64) + np.uint64(1 << 40))
    tail[at_rare], tail[at_common] = ~(rare & 0x7FFFFFFF).astype(np.int32), common
    rows[at_rare], rows[at_common] = heavy.words(rare, common)
    return _Sequences(ends, key, tail, rows, n, sj.need(n, permille))


def _entries(s: _Sequences, heavy: Heavy, only: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """owner, key, place of the key's last word, room, depth and blocks of the
    rows of all keys. ``only``: keys of so many words before they are split."""
    owner = np.repeat(np.arange(len(s.n)), s.n)
    at = np.arange(len(owner))
    room = (s.n - s.need)[owner] - (at - s.ends[owner])
    own = np.flatnonzero(room >= 0)
    owner, at, room, key, rows = owner[own], own, room[own], s.key[own], s.rows[own]
    for depth in range(1, DEEPEST_KEY + 1):
        if depth == only:
            yield owner, key, at, room, depth, np.ones(len(owner), np.int64)
            return
        split = rows > SPLIT_GROUP
        if not only:
            # a row that needs no more words in common than the key has can't be split
            last = split & ((s.need[owner] <= depth) if depth < DEEPEST_KEY else True)
            for which, blocks in ((~split, np.ones(len(owner), np.int64)), (last, -(-rows // BLOCK_ROWS))):
                if which.any():
                    yield owner[which], key[which], at[which], room[which], depth, blocks[which]
        if not split.any() or depth == DEEPEST_KEY:
            return
        owner, key, at, room = owner[split], key[split], at[split], room[split]
        choices = np.minimum(room + 1, s.ends[owner + 1] - at - 1)
        each = np.repeat(np.arange(len(owner)), choices)
        ahead = np.arange(len(each)) - np.repeat(np.cumsum(choices) - choices, choices) + 1
        owner, at, room = owner[each], at[each] + ahead, room[each] + 1 - ahead
        key = mix(key[each] ^ mix(s.key[at]))
        rows = heavy.keys(depth + 1, key)


def _key_counter(permille: int, heavy: Heavy, depth: int):
    """Keys of ``depth`` words that the heavy shorter ones are split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for _, key, *_ in _entries(_sequences(batch, permille, heavy), heavy, depth):
                    values, n = np.unique(key.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["key", "n"])

    return run


def _prefixes(permille: int, heavy: Heavy):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column("uid").to_numpy()
            s = _sequences(batch, permille, heavy)
            bits = sj.sketches(np.repeat(np.arange(len(s.n)), s.n), s.key, len(s.n))
            for owner, key, at, room, depth, blocks in _entries(s, heavy):
                # words of few rows need no further words
                further = (s.rows[at] > SMALL_GROUP) | (s.tail[at] >= 0) | (depth > 1)
                stop = np.where(further, np.minimum(at + room + DEEPEST, s.ends[owner + 1]), 0)
                start = at + 1
                if (blocks > 1).any():
                    # a row of block b meets those of block c under the key of both
                    each = np.repeat(np.arange(len(owner)), blocks)
                    c = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    b = (mix(uid[owner].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[each]
                    pair = (np.minimum(b, c) << 32 | np.maximum(b, c)).astype(np.uint64)
                    key = np.where(blocks[each] > 1, mix(key[each] + mix(pair)), key[each])
                    owner, room, start, stop = owner[each], room[each], start[each], stop[each]
                tail_ends, tail = _slices(s.tail, start, stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(uid[owner]),
                        pa.array(s.n[owner].astype(np.int32)),
                        pa.array(room.astype(np.int32)),
                        pa.array(np.full(len(owner), depth, np.int32)),
                        sj.fixed_binary(bits[owner]),
                        _lists(tail_ends, tail),
                    ],
                    ["key", "id", "n", "room", "depth", "bits", "tail"],
                )

    return rows


def _choose(n: np.ndarray, k: int) -> np.ndarray:
    total = np.ones(len(n))
    for x in range(k):
        total *= np.maximum(n - x, 0) / (x + 1)
    return total


def _meetings(rows: np.ndarray, width: np.ndarray, tail_ends: np.ndarray, tail: np.ndarray, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners of all combinations of ``more`` words of the rows' tails, sorted
    by combination, and the ends of the runs of equal ones. Combinations are
    made for some first words at a time, so that memory stays bounded."""
    width = np.minimum(width, np.diff(tail_ends)[rows])
    firsts = np.maximum(width - more + 1, 0)
    entry = np.repeat(np.arange(len(rows)), firsts)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(firsts) - firsts, firsts)
    rest = width[entry] - at - 1
    at += tail_ends[rows[entry]]
    by = np.argsort(tail[at], kind="stable")
    entry, at, rest = entry[by], at[by], rest[by]
    word = tail[at].astype(np.int64)
    cost = np.cumsum(_choose(rest, more - 1))
    hashed = more > 3 or bool(len(tail) and tail.min() < 0)
    begin = 0
    while begin < len(word):
        stop = int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + BLOCK_COMBINATIONS, "right"))
        stop = max(stop, begin + 1)
        # whole words only: all combinations that begin with a word meet
        stop = int(np.searchsorted(word, word[stop - 1], "right"))
        block = slice(begin, stop)
        begin = stop
        top = int(rest[block].max())
        inside = np.arange(top) < rest[block][:, None]
        grid = np.zeros(inside.shape, np.int64)
        grid[inside] = _slices(tail, at[block] + 1, at[block] + 1 + rest[block])[1]
        signs, owners = [], []
        for columns in combinations(range(top), more - 1):
            own = np.flatnonzero(inside[:, columns[-1]]) if columns else np.arange(stop - block.start)
            sign = word[block][own]
            for x in columns:
                sign = mix(sign.astype(np.uint64) * np.uint64(1 << 21) + grid[own, x].astype(np.uint64)).view(np.int64) if hashed else sign << 21 | grid[own, x]
            signs.append(sign)
            owners.append(entry[block][own])
        sign, owner = np.concatenate(signs), rows[np.concatenate(owners)]
        order = np.argsort(sign)
        sign = sign[order]
        yield owner[order], np.flatnonzero(np.concatenate([sign[1:] != sign[:-1], [True]])) + 1


def _estimate(rows: np.ndarray, width: np.ndarray, tail_ends: np.ndarray, tail: np.ndarray, more: int) -> float:
    """Number of candidates that combinations of ``more`` words would make, from
    a sample of the rows. It decides about the cost only, not the result."""
    some = np.unique(np.linspace(0, len(rows) - 1, ESTIMATE_ROWS).astype(np.int64))
    total = 0.0
    for _, ends in _meetings(rows[some], width[some], tail_ends, tail, more):
        run = np.diff(ends, prepend=0)
        total += float((run * (run - 1) // 2).sum())
    return total * (len(rows) / len(some)) ** 2


def _by_further_words(n, room, depth, bits, tail_ends, tail, permille) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a large group: rows that share the further words that their
    number of candidates calls for."""
    size = len(n)
    lengths = np.diff(tail_ends)
    # room counts from the last key word; with k further words, the last of
    # them stands at most room + k places behind it
    most = DEEPEST - 1
    alone = np.minimum(lengths, room + most) > LONG_TAIL
    alone |= sj.need(n, permille) < depth + most
    found: list[np.ndarray] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.minimum(i, j), np.maximum(i, j)
        ok = (i != j) & sj.may_match(i, j, n, bits, permille)
        found.append(np.unique(i[ok] * size + j[ok]))
        if len(found) > 64:  # pairs recur; what is held stays small
            found[:] = [np.unique(np.concatenate(found))]

    few = np.flatnonzero(alone)
    start = np.searchsorted(n, sj.need(n[few], permille), "left")
    stop = np.searchsorted(n, n[few] * 1000 // permille, "right")
    for k, j in sj.ranges(start, stop):
        keep(few[k], j)

    rest = np.flatnonzero(~alone)
    for more in range(1, most + 1) if len(rest) else ():
        width = np.minimum(lengths[rest], room[rest] + more)
        if more < most and _estimate(rest, width, tail_ends, tail, more) > COMBINATION * _choose(width + 1, more + 1).sum():
            continue
        for owner, ends in _meetings(rest, width, tail_ends, tail, more):
            last = np.repeat(ends, np.diff(ends, prepend=0))
            for k, j in sj.ranges(np.arange(len(owner)) + 1, last):
                keep(owner[k], owner[j])
        break
    each = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return each // size, each % size


def _candidates(permille: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sj.blocks_by_key(batches):
            group = sj.group_numbers(table.column("key").to_numpy())
            n = table.column("n").to_numpy().astype(np.int64)
            uid = table.column("id").to_numpy()
            bits = sj.as_words(table.column("bits"))
            size = np.bincount(group)
            small = size[group] <= SMALL_GROUP
            a, b = [], []
            own = np.flatnonzero(small)
            for i, j in sj.pairs_within(group[own], n[own], permille):
                i, j = own[i], own[j]
                ok = sj.may_match(i, j, n, bits, permille)
                a.append(uid[i[ok]])
                b.append(uid[j[ok]])
            if not small.all():
                room, depth = table.column("room").to_numpy(), table.column("depth").to_numpy()
                tail_ends, tail = _ends(table.column("tail").combine_chunks())
                first = np.concatenate([[0], np.cumsum(size)])
                for g in np.flatnonzero(size > SMALL_GROUP):
                    s = slice(first[g], first[g + 1])
                    te = tail_ends[first[g] : first[g + 1] + 1]
                    i, j = _by_further_words(n[s], room[s].astype(np.int64), int(depth[first[g]]), bits[s], te, tail, permille)
                    a.append(uid[s][i])
                    b.append(uid[s][j])
            x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
            x, y = np.minimum(x, y), np.maximum(x, y)
            each = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0].copy()), pa.array(each[:, 1].copy())], ["a", "b"])

    return pairs


def near_copies(
    df: DataFrame,
    *,
    id_col: str,
    text_col: str,
    group_col: str | Column | None = None,
    threshold: float = 0.7,
    min_words: int = 12,
) -> NearCopies:
    """Near-same records of ``df``, within each group.

    Near-same: both texts have ``min_words`` words or more, and the words in
    common, repeats counted, are at least ``threshold`` of the words of the
    longer. Null, blank and shorter texts are in no class. ``id_col`` is a
    unique bigint within its group; a row delivered twice under one id counts
    once. Other columns are ignored, whatever their names.
    """
    permille = round(threshold * 1000)
    spark = df.sparkSession
    group = F.lit("") if group_col is None else F.col(group_col) if isinstance(group_col, str) else group_col
    texts = df.select(
        F.coalesce(group.cast("string"), F.lit("")).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    ).where("id is not null and text is not null")

    counts = texts.mapInArrow(_common, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = texts.count()
    # bounded: see COMMON
    common = counts.where(F.col("n") >= max(2.0, COMMON * total)).collect()
    common.sort(key=lambda x: (x.n, x.word))
    hashes = np.asarray([x.word for x in common], np.int64)

    coded = materialise(
        texts.mapInArrow(_encoder(hashes, min_words), "grp string, id long, one long, two long, rare array<long>, common array<int>"), "coded"
    )
    key = ["grp", "one", "two"]
    classes = materialise(
        coded.groupBy(*key)
        .agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("rare").alias("rare"), F.first("common").alias("common"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "classes",
    )
    members = coded.select(*key, "id").distinct().join(classes.select(*key, "class_id", "copies"), key).select("grp", "id", "class_id", "copies")

    rare = np.empty(0, np.int64)
    if max(2.0, COMMON * total) > SMALL_GROUP:  # no rare word is in more rows than that
        bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
        filled = classes.select(F.explode("rare").alias("word")).groupBy(bucket).count().where(F.col("count") > SMALL_GROUP)
        filled = filled.toArrow()  # a line per bucket at most
        rare = np.zeros(BUCKETS, np.int64)
        rare[filled.column("bucket").to_numpy()] = filled.column("count").to_numpy()
    heavy = Heavy(np.asarray([x.n for x in common], np.int64), rare)
    words = classes.select("uid", "rare", "common")
    while heavy.deepest() and len(heavy.longer) + 2 <= DEEPEST_KEY:
        counted = words.mapInArrow(_key_counter(permille, heavy, len(heavy.longer) + 2), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        # each has SPLIT_GROUP rows: they are few
        more = counted.where(F.col("n") > SPLIT_GROUP).orderBy("key").toArrow()
        heavy = replace(heavy, longer=(*heavy.longer, (more.column("key").to_numpy(), more.column("n").to_numpy())))

    width = shuffle_width(spark)
    found = (
        words.mapInArrow(_prefixes(permille, heavy), _PREFIX)
        .repartition(width, "key")
        .sortWithinPartitions("key", "n")
        .mapInArrow(_candidates(permille), "a long, b long")
        .distinct()
    )
    side = lambda x: classes.select(
        F.col("uid").alias(x), "grp", F.col("class_id").alias(f"class_{x}"), F.col("rare").alias(f"rare_{x}"), F.col("common").alias(f"common_{x}")
    )
    both = found.join(side("a"), "a").join(side("b").drop("grp"), "b")
    size = lambda x: F.size(f"rare_{x}") + F.size(f"common_{x}")
    shared = F.size(F.array_intersect("rare_a", "rare_b")) + F.size(F.array_intersect("common_a", "common_b"))
    pairs = (
        both.withColumn("common_words", shared)
        .where(F.col("common_words") * 1000 >= F.greatest(size("a"), size("b")) * permille)
        .select("grp", F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "common_words")
    )
    return NearCopies(members, materialise(pairs, "near_pairs"))
