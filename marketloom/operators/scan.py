"""Linear recurrences over an order of rows, x[n] = a[n] * x[n - 1] + b[n], by composing maps: within blocks of consecutive rows, then over
blocks, and over blocks of blocks. A block is a thousand rows whatever their keys, so a ledger of a million events is many tasks' work.
A row with a = 0 begins anew; with one such row ahead of each key's rows one scan serves all keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.numbering import numbered
from marketloom.sources.writes import kept

BITS = 10


def opened(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with their place `n` in the order of keys, and one row ahead of each key's (`_opens`)."""
    first = rows.select(*keys).distinct().withColumn("_opens", F.lit(0))
    every = rows.withColumn("_opens", F.lit(1)).unionByName(first, allowMissingColumns=True)
    return numbered(every, [*(F.col(k) for k in keys), F.col("_opens"), *(F.col(c) for c in order)])


def closed(rows: DataFrame) -> DataFrame:
    return rows.where("_opens = 1").drop("_opens")


def scanned(rows: DataFrame, a: Column, b: Column, out: str, place: str = "n", bits: int = BITS) -> DataFrame:
    """rows with `out` and `<out>_before`: x after and before each row, in the order of `place` (whole numbers from 0); x is 0 at first."""
    w = Window.partitionBy("_block").orderBy(place)
    x = rows.withColumns({"_block": F.shiftright(place, bits), "_a": a.cast("double"), "_b": b.cast("double")})
    for k in range(bits):  # after step k a row holds the map of the 2 << k rows up to it
        x = x.withColumns({"_pa": F.lag("_a", 1 << k, 1.0).over(w), "_pb": F.lag("_b", 1 << k, 0.0).over(w)})
        x = x.withColumns({"_b": F.col("_a") * F.col("_pb") + F.col("_b"), "_a": F.col("_a") * F.col("_pa")})
    x = kept(x.withColumns({"_pa": F.lag("_a", 1, 1.0).over(w), "_pb": F.lag("_b", 1, 0.0).over(w)}), "maps")
    blocks = x.groupBy("_block").agg(F.max_by(F.struct("_a", "_b"), place).alias("m")).select(F.col("_block").alias("n"), "m.*")
    last = x.agg(F.max("_block")).first()[0]
    if last:
        begin = scanned(blocks, F.col("_a"), F.col("_b"), "_x", "n", bits).select(F.col("n").alias("_block"), F.col("_x_before").alias("_x"))
        x = x.join(begin, "_block")
    else:
        x = x.withColumn("_x", F.lit(0.0))
    return x.withColumns({out: F.col("_a") * F.col("_x") + F.col("_b"), f"{out}_before": F.col("_pa") * F.col("_x") + F.col("_pb")}).drop("_block", "_a", "_b", "_pa", "_pb", "_x")
