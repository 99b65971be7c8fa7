"""Ranks, running sums and neighbours over a whole table without a single-partition window.

A window without partitions moves every row to one task. Here the rows are cut into ranges of about equal size by
sampling, whatever the keys look like, and sorted inside. A small table with a row for each range carries what must be
known of the ranges before, and a window inside each range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import cut

BLOCK = 1 << 14
MOST_BLOCKS = 1 << 18


def block_size(rows: int) -> int:
    """A power of two, by which dense keys 1..``rows`` fall into at most ``MOST_BLOCKS`` blocks."""
    return max(BLOCK, 1 << (rows // MOST_BLOCKS).bit_length())


def _block(order: Column, block: int) -> Column:
    """The block of a bigint key; ``block`` is a power of two, so that no key loses digits."""
    return F.shiftright(order.cast("bigint"), block.bit_length() - 1)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` as a table with ``_part``, the range of a row in the order, and ``_pos``, its place in it from 0. Rows of
    equal order are in one range. The number of a row made from task and place is what a sorted partition gives for free,
    so one shuffle does it; it is written, as ranges are drawn from a sample and would differ when computed again."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    placed = cut(placed, "ranges")
    return placed.withColumn("_part", F.shiftright("_pos", 33).cast("int")).withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))


def _before(parts: DataFrame, value: Column) -> DataFrame:
    """Of a table with a row a range: the sum of ``value`` over the ranges before."""
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return parts.select("_part", F.coalesce(F.sum(value).over(back), F.lit(0)).alias("_start"))


def running_sum(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one by ``order`` (unique). Null values add
    nothing; rows with a null order come first."""
    src = in_ranges(df.withColumn("_order", order).withColumn("_value", F.coalesce(value, F.lit(0))), F.col("_order"))
    start = _before(src.groupBy("_part").agg(F.sum("_value").alias("_sum")), F.col("_sum"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return src.withColumn("_inside", inside).join(start, "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_pos", "_order", "_value", "_start", "_inside")


def row_numbers(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... along ``order``, which may have several keys; with equal ones any order."""
    src = in_ranges(df, *order)
    start = _before(src.groupBy("_part").agg(F.count("*").alias("_n")), F.col("_n"))
    return src.join(start, "_part").withColumn(name, F.col("_start") + F.col("_pos") + 1).drop("_part", "_pos", "_start")


def previous_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` of distinct values with ``name``: the next smaller one."""
    src = in_ranges(df, F.col(column))
    tops = src.groupBy("_part").agg(F.max(column).alias("_top"))
    tops = tops.select("_part", F.lag("_top").over(Window.orderBy("_part")).alias("_before"))  # a row a range
    inside = F.lag(column).over(Window.partitionBy("_part").orderBy("_pos"))
    return src.withColumn("_inside", inside).join(tops, "_part").withColumn(name, F.coalesce("_inside", "_before")).drop("_part", "_pos", "_before", "_inside")


def next_set(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the first non-null ``value`` of the rows after this one by ``order`` (unique)."""
    src = in_ranges(df.withColumn("_order", order).withColumn("_value", value), F.col("_order"))
    heads = src.groupBy("_part").agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_pos"))).alias("_head"))
    # Backwards: a frame that grows is kept up row by row, one that shrinks is summed anew for every row.
    later = F.last("_head", ignorenulls=True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("_part", later.alias("_later"))  # a row a range
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy("_part").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1))
    return src.withColumn("_inside", inside).join(heads, "_part").withColumn(name, F.coalesce("_inside", "_later")).drop("_part", "_pos", "_order", "_value", "_later", "_inside")
