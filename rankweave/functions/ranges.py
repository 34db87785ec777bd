"""Places and running sums in a total order, by ranges, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.storage import written

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33


def _ranged(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Written rows in ranges of the keys, sorted there, with ``_part`` and ``_at`` (the place in it, from 0)."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed = written(ranged, "ranges")
    return placed.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("_id")


def numbered(df: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """Add the long column ``name``: 0, 1, 2, ... in the order of ``keys``, which no two rows share."""
    placed = _ranged(df, keys)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def running_sum(df: DataFrame, keys: list[Column | str], value: str, name: str, total: str) -> DataFrame:
    """Add ``name``, the sum of the long column ``value`` over this row and all before it in the order of ``keys`` (which no two rows share), and ``total``, the sum over all rows.

    Partitions add what those before them sum up to; inside one a window goes
    through its range alone.
    """
    placed = _ranged(df, keys)
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_n"))  # a row a partition
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias(total))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_at", "_start", "_inside")
