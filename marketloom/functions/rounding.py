"""Rounding that gives the same double in another engine: sums taken in another order differ in the last bits, and exact
ties would then go either way. The half is raised by a little, so ties and what is near them go up on both sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 0.50001


def half_up(c: Column, digits: int) -> Column:
    ten = 10.0**digits
    return F.floor(c * F.lit(ten) + F.lit(NUDGE)) / F.lit(ten)


def half_up_sql(c: str, digits: int) -> str:
    return f"(floor(({c}) * 1e{digits}::DOUBLE + {NUDGE}::DOUBLE) / 1e{digits}::DOUBLE)"


def r(*names: str, digits: int = 4) -> list[Column]:
    return [half_up(F.col(n), digits).alias(n.rpartition(".")[2]) for n in names]


def R(*names: str, digits: int = 4) -> str:
    return ", ".join(f"{half_up_sql(n, digits)} AS {n.rpartition('.')[2]}" for n in names)
