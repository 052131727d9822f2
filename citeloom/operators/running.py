"""Running numbers, sums and last values that split a group over many tasks.

A plain window sends a whole group through one task. Here the table is sorted by
range, so a large group spans several segments; each segment is numbered on its own
and takes what the earlier segments of its group add up to.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import staged

_SEGMENT = "_segment"


def _segments(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with the number of their range-sorted segment, written once so that it is settled."""
    ordered = rows.repartitionByRange(*[F.col(c) for c in by], *order)
    return staged(ordered.withColumn(_SEGMENT, F.spark_partition_id()))


def _carried(parts: DataFrame, by: list[str], name: str, total: Column, combine) -> DataFrame:
    """``combine`` over the earlier segments of each group: one row per group and segment."""
    per_segment = parts.groupBy(*by, _SEGMENT).agg(total.alias("_part"))
    earlier = Window.partitionBy(*by).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return per_segment.select(*by, _SEGMENT, combine(F.col("_part")).over(earlier).alias(name))


def _started(parts: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """Each row with what its group's earlier segments come to; a null in a group column is a value like any other."""
    keys = [*by, _SEGMENT]
    named = starts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_before")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return parts.join(named, same).drop(*[f"_of_{c}" for c in keys])


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to each row of its group."""
    parts = _segments(rows.withColumn("_value", value), by, order)
    before = _carried(parts, by, "_before", F.sum("_value"), F.sum)
    here = F.sum("_value").over(Window.partitionBy(*by, _SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _started(parts.withColumn("_here", here), before, by)
    total = F.col("_here") + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, total).drop("_value", "_here", "_before", _SEGMENT)


def running_number(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the position of each row in its group, from 1."""
    numbered = running_sum(rows, by, order, F.lit(1), name)
    return numbered.withColumn(name, F.col(name).cast("int"))


def running_last(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to each row of its group."""
    parts = _segments(rows.withColumn("_value", value), by, order)
    inside = Window.partitionBy(*by, _SEGMENT).orderBy(*order)
    here = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    local = parts.withColumn("_here", here).withColumn("_n", F.row_number().over(inside))
    before = _carried(local, by, "_before", F.max_by("_here", "_n"), lambda c: F.last(c, ignorenulls=True))
    joined = _started(local, before, by)
    return joined.withColumn(name, F.coalesce("_here", "_before")).drop("_value", "_here", "_n", "_before", _SEGMENT)
