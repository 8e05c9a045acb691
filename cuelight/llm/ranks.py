"""Ranks of rows in groups of any size, by sorting ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.tables import stored

#: monotonically_increasing_id counts rows of a partition in these low bits
IN_PARTITION = 33


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df``, stored, with a number of its own for every row; equal rows have different numbers."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank", size: str = "size") -> DataFrame:
    """Rows of a stored table with their 0-based ``rank`` in the rows of one ``group`` (a column without nulls), and the group's size.

    ``order`` must end in a column that differs in every row, so that a group or a run of equal rows of any length falls into many
    ranges. A row's place in its range is known from the sort; ranges before it add one number per range and group.
    """
    keys = [F.col(group), *order]
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", IN_PARTITION))
    parts = rows.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_move"),
                         F.sum("_n").over(whole).alias(size))
    return rows.join(parts, [group, "_range"]).withColumn(name, F.col("_at") + F.col("_move")).drop("_at", "_range", "_move")
