"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.scratch import Scratch

#: Bits of ``monotonically_increasing_id`` that count rows of one partition.
ROW_BITS = 33


def numbered(df: DataFrame, keys: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Add the long column ``name``: 0, 1, 2, ... in the order of ``keys``.

    Rows are dealt by ranges of the keys and sorted there; each partition adds
    the number of rows in those before it, of which only one row a partition is
    brought together.  ``df`` has to read a written table: equal keys are parted
    by the place in its files, so that any number of equal rows can be split.
    """
    tied = [*keys, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*tied).sortWithinPartitions(*tied)
    placed = scratch.keep(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    return joined.withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")
