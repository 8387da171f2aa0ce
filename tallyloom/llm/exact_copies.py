"""Records that differ only in formatting: sort, then scan adjacent runs.

Each record gets a canonical key. Keys are range-partitioned together with the
record's id, so that a key shared by a third of all rows spreads over as many
tasks as it needs, sorted externally, and scanned once: rows of one run are
copies of its first row. A run that goes on in the next partition is joined up
from one line per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.textform import WORD, clean
from tallyloom.storage import materialise, shuffle_width

# The labels of a labelled record.
LABELS = ("subreddit", "title", "flair", "comment")


@dataclass(frozen=True)
class Copies:
    """copies: grp, first_id, copy_id, a row per record that is not the first
    of its group. runs: grp, id, copies and edge, a row per group with the number
    of its records; a group at the edge of a partition may have several rows.
    alone: grp, id of the records that can have no copies."""

    copies: DataFrame
    runs: DataFrame
    alone: DataFrame

    def collapsed(self) -> DataFrame:
        """grp, id, copies: one row per group, with the number of its records."""
        edges = self.runs.where("edge").groupBy("grp", "id").agg(F.sum("copies").alias("copies"))  # two rows per partition at most
        return (
            self.runs.where("not edge").select("grp", "id", "copies").unionByName(edges)
            .unionByName(self.alone.distinct().select("grp", "id", F.lit(1).cast("long").alias("copies")))
        )


def _label_pattern(labels: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"""(?<![^\W_])({"|".join(labels)})(?![^\W_])[\s"'`*“”‘’«»]*[:=]""")


def canonical_key(text: str, label: re.Pattern, min_words: int) -> str | None:
    """What equal records have in common; none for texts of fewer words. Texts
    without any word are the same if they are but for their blanks."""
    text = clean(text).lower()
    words = WORD.findall(text)
    if len(words) < min_words:
        return None
    if not words:
        return "\t" + "".join(text.split())
    marks = list(label.finditer(text))
    if len(marks) >= 2 and marks[0].start() == WORD.search(text).start():
        stops = [m.start() for m in marks[1:]] + [len(text)]
        fields = (m[1] + "=" + "".join(WORD.findall(text, m.end(), stop)) for m, stop in zip(marks, stops, strict=True))
        return "\n" + "\n".join(sorted(fields))
    return "".join(words)


def _keys(labels: tuple[str, ...], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _label_pattern(labels)
        for batch in batches:
            key = pa.array([None if x is None else canonical_key(x, label, min_words) for x in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([key, batch.column("grp"), batch.column("id")], ["key", "grp", "id"])

    return run


# kind 0: a copy; 1: the first and last run of a partition; 2: a run, its number of records as copy_id
_SCANNED = (
    "part int, kind int, grp string, first_id long, copy_id long, head boolean, first_key string, last_key string, last_grp string, last_first long, whole boolean"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies and runs within this partition, and a line about its first and
    last run. ``whole`` of a run: it is the last one."""
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _SCANNED.split(", ")]
    before = None  # key, grp, id of the last row so far
    head_first = run_first = start = None
    in_head, held = True, 0  # records of the run that goes on

    def lines(kind: int, grp: pa.Array, first: np.ndarray, other: np.ndarray, head: np.ndarray, last: bool) -> pa.RecordBatch:
        n = len(first)
        none = pa.nulls(n, pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32)), grp, pa.array(first), pa.array(other), pa.array(head),
                none, none, none, pa.nulls(n, pa.int64()), pa.array(np.full(n, last)),
            ],
            names,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        key, grp, ids = batch.column("key"), batch.column("grp"), batch.column("id").to_numpy()
        same = np.zeros(len(ids), bool)
        same[1:] = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(grp[1:], grp[:-1])).to_numpy(zero_copy_only=False)
        if before is None:
            start = (key[0].as_py(), grp[0].as_py())
            head_first = run_first = ids[0]
        else:
            same[0] = before[:2] == (key[0].as_py(), grp[0].as_py())
        at = np.arange(len(ids))
        opening = np.maximum.accumulate(np.where(same, -1, at))
        first = np.where(opening < 0, run_first, ids[opening])
        head = np.logical_and.accumulate(same | ((at == 0) & (before is None))) & in_head
        again = same.copy()
        again[1:] &= ids[1:] == ids[:-1]
        again[0] &= before is not None and before[2] == ids[0]
        out = np.flatnonzero(same & ~again)
        if len(out):
            yield lines(0, grp.take(pa.array(out)), first[out], ids[out], head[out], False)
        # runs that end before a row of this batch: the one held, then its own
        opened = np.flatnonzero(~same)
        own = np.cumsum(~again)
        if len(opened):
            stops = own[opened] - 1
            if before is not None:
                yield lines(2, pa.array([before[1]], pa.string()), np.asarray([run_first]), np.asarray([held + stops[0]]), np.asarray([in_head]), False)
            if len(opened) > 1:
                yield lines(2, grp.take(pa.array(opened[:-1])), ids[opened[:-1]], np.diff(stops), head[opened[:-1]], False)
            held = int(own[-1] - stops[-1])
        else:
            held += int(own[-1])
        before, run_first, in_head = (key[-1].as_py(), grp[-1].as_py(), ids[-1]), first[-1], bool(head[-1])
    if before is not None:
        yield lines(2, pa.array([before[1]], pa.string()), np.asarray([run_first]), np.asarray([held]), np.asarray([in_head]), True)
        line = [part, 1, start[1], head_first, None, True, start[0], before[0], before[1], run_first, in_head]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(line, kinds, strict=True)], names)


def formatting_copies(
    df: DataFrame,
    *,
    id_col: str,
    text_col: str,
    group_col: str | Column | None = None,
    labels: tuple[str, ...] = LABELS,
    min_words: int = 12,
) -> Copies:
    """Records of one group whose texts are the same but for spacing, case,
    punctuation, look-alike characters or the order of labelled fields.

    Null texts and texts of fewer than ``min_words`` words have no copies. With
    ``min_words`` 0, texts without any word are the same if they differ in blanks
    only; all blank ones are. The first record of a group is the one with the
    smallest id. A row delivered twice under one id counts once. Other columns
    are ignored.
    """
    group = F.lit("") if group_col is None else F.col(group_col) if isinstance(group_col, str) else group_col
    rows = df.select(F.coalesce(group.cast("string"), F.lit("")).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null")
    keys = materialise(rows.mapInArrow(_keys(labels, min_words), "key string, grp string, id long"), "canonical")
    width = shuffle_width(df.sparkSession)
    order = ("key", "grp", "id")
    scanned = materialise(keys.where("key is not null").repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_scan, _SCANNED), "runs")

    by_part = Window.orderBy("part")
    edges = scanned.where("kind = 1").withColumn(
        "joined", F.coalesce((F.col("first_key") == F.lag("last_key").over(by_part)) & (F.col("grp") == F.lag("last_grp").over(by_part)), F.lit(False))
    )
    opened = F.when(~(F.col("whole") & F.col("joined")), F.col("last_first"))
    edges = edges.withColumn("carried", F.last(opened, ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))).where("joined")
    carried = edges.select("part", "carried")  # one line per partition of the sort
    inside = (
        scanned.where("kind = 0")
        .join(F.broadcast(carried), "part", "left")
        .select("grp", F.when(F.col("head"), F.coalesce("carried", "first_id")).otherwise(F.col("first_id")).alias("first_id"), "copy_id")
    )
    opening = edges.where("carried <> first_id").select("grp", F.col("carried").alias("first_id"), F.col("first_id").alias("copy_id"))
    runs = (
        scanned.where("kind = 2")
        .join(F.broadcast(carried), "part", "left")
        .select("grp", F.when(F.col("head"), F.coalesce("carried", "first_id")).otherwise(F.col("first_id")).alias("id"), F.col("copy_id").alias("copies"), (F.col("head") | F.col("whole")).alias("edge"))
    )
    return Copies(inside.where("first_id <> copy_id").unionByName(opening), runs, keys.where("key is null").select("grp", "id"))
