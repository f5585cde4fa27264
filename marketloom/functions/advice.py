"""Reading recommendations: expected direction and position, with a guard against negation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed words, in the order they are looked for.
BULLISH = ("买入", "加仓", "强烈买入", "增持", "建仓", "strong buy", "buy", "add")
BEARISH = ("卖出", "减仓", "强烈卖出", "清仓", "strong sell", "sell", "reduce")
HOLD = ("持有", "hold")
WAIT = ("观望", "等待", "wait")
NEGATIONS = ("not", "don't", "do not", "no", "never", "avoid", "不要", "不", "别", "勿", "没有")


def _means(text: Column, words: Sequence[str]) -> Column:
    """Whether the first occurrence of any word isn't right after a negation; a text that is just the word always counts."""
    negated = "(?:" + "|".join(NEGATIONS) + r")\s*$"
    found = F.lit(False)
    for w in words:
        at = F.instr(text, w)
        found = found | (text == w) | ((at > 0) & ~F.substring(text, F.lit(1), at - 1).rlike(negated))
    return found


def direction(advice: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(advice, F.lit(""))))
    return F.when(_means(t, BEARISH), "down").when(_means(t, WAIT), "flat").when(_means(t, BULLISH), "up").when(_means(t, HOLD), "not_down").otherwise("flat")


def position(advice: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(advice, F.lit(""))))
    return F.when(_means(t, BEARISH) | _means(t, WAIT), "cash").when(_means(t, BULLISH) | _means(t, HOLD), "long").otherwise("cash")
