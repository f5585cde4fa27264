"""Places of rows in one order over a whole table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.writes import kept


def ranged(df: DataFrame, order: list[Column], name: str = "ranged") -> tuple[DataFrame, DataFrame]:
    """(rows, ranges). Rows are dealt to ranges of the order and sorted within; `_i` holds the range and the place in it. ranges: a
    row for each with its number (part), how many rows it has (n) and how many come before it (before)."""
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), name)
    ranges = rows.groupBy(F.shiftright("_i", 33).alias("part")).agg(F.count("*").alias("n"))
    # one row for each range, so one task may order them
    return rows, ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with each row's place in the order, from 0. What is equal in the order gets places that are stable once written."""
    rows, ranges = ranged(df, order)
    found = rows.withColumn("_p", F.shiftright("_i", 33)).join(F.broadcast(ranges.select(F.col("part").alias("_p"), "before")), "_p")
    return found.withColumn(name, F.col("before") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_i", "_p", "before")
