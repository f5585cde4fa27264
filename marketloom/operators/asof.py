"""As-of joins without range joins: both sides are put in one order and the last row of the right side is carried on.

One shuffle by the keys and one sort, whatever the sizes; no pair of rows is formed that isn't returned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, take: str, tie: Sequence[str] = ()) -> DataFrame:
    """left with column `take`: a struct of right's row with the greatest right_on <= on, null if there is none. Of equal
    right_on the greatest by `tie` counts."""
    shown = F.struct(*right.columns)
    a = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*(F.col(t) for t in tie)).alias("_tie") if tie else F.struct(F.lit(0).alias("_0")).alias("_tie"), shown.alias(take))
    b = left.select(*keys, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(take, F.last(take, ignorenulls=True).over(w))
    return both.where("_side = 1").select("_left.*", take)
