"""Ranks and running totals over whole groups without holding a group in one
task: rows are range-partitioned and sorted, numbered within their partition,
and offset by the few lines that sum up the partitions before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.storage import materialise, shuffle_width

_PART_BITS = 33  # monotonically_increasing_id: partition above, row below


def _sorted(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    keys = [*group, *order]
    spread = df.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    numbered = spread.withColumn("__at", F.monotonically_increasing_id())
    return materialise(numbered.withColumn("__part", F.shiftright("__at", _PART_BITS)), "sorted")


def global_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with ``name``, the row's place in its group from 0, and
    ``name``_of, the size of the group. Nulls in ``group`` are a group; they
    come first in ``order``. ``order`` should be unique within a group."""
    rows = _sorted(df, group, order)
    lines = rows.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset, size = F.coalesce(F.sum("__n").over(before), F.lit(0)), F.sum("__n").over(whole)
    keys = {f"__key{k}": c for k, c in enumerate(["__part", *group])}
    lines = lines.select(*(F.col(c).alias(k) for k, c in keys.items()), F.col("__first"), offset.alias("__offset"), size.alias("__of"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for k, c in keys.items()))
    place = F.col("__at") - F.col("__first") + F.col("__offset")
    return rows.join(lines, same).select(*df.columns, place.alias(name), F.col("__of").alias(f"{name}_of"))


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "running") -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before it."""
    rows = _sorted(df, [], order)
    lines = rows.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a line per partition
    lines = lines.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.withColumn("__local", local).join(lines, "__part").select(*df.columns, (F.col("__local") + F.col("__offset")).alias(name))


def hash_order(seed: int, *columns: Column | str) -> Column:
    """A shuffled, repeatable order: the md5 of the seed and the columns.
    Nulls come last."""
    text = F.concat_ws(":", F.lit(str(seed)), *columns)
    known = reduce(lambda a, b: a & b, ((F.col(c) if isinstance(c, str) else c).isNotNull() for c in columns))
    return F.when(known, F.md5(text)).otherwise(F.lit("~"))
