"""Whole-market screening: universe, factor snapshot, rules, final ranking, health of the day's bars."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.rounding import half_up


def W() -> WindowSpec:  # noqa: N802  windows need a session, so they are made when asked for
    return Window.partitionBy("code").orderBy("date")



def universe(raw: DataFrame) -> DataFrame:
    """raw: ord, code, name, ... Codes trimmed and in capitals, blanks and null words dropped, the first of each code."""
    code = F.upper(F.trim("code"))
    df = raw.withColumn("code", code).where(F.col("code").isNotNull() & ~F.col("code").isin("", "NONE", "NAN", "NULL"))
    df = df.withColumn("name", F.coalesce("name", "code")).withColumn("is_st", F.upper("name").contains("ST"))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("ord"))).where("_r = 1").drop("_r", "ord")


def factor_snapshot(bars: DataFrame, instruments: DataFrame, trade_date: datetime.date, lookback: int = 120, breakout: int = 20, min_list_days: int = 120) -> DataFrame:
    """A row for each instrument with 20 bars in the last 2 * lookback days, the last of them on trade_date."""
    df = bars.where(F.col("date").between(F.date_sub(F.lit(trade_date), 2 * lookback), F.lit(trade_date)))
    df = df.join(instruments.select("code", "name", "list_date", "is_st"), "code")
    last = lambda c, n: F.avg(c).over(W().rowsBetween(-(n - 1), 0))
    before = W().rowsBetween(-5, -1)
    df = df.withColumns(
        {
            "n": F.count("*").over(W().rowsBetween(Window.unboundedPreceding, 0)),
            "ma5": last("close", 5), "ma10": last("close", 10), "ma20": last("close", 20), "ma60": last("close", 60),
            "high_before": F.max("high").over(W().rowsBetween(-breakout, -1)),
            "_amount": F.coalesce(F.avg(F.coalesce("amount", F.lit(0.0))).over(before), F.lit(0.0)),
            "_volume": F.coalesce(F.avg(F.coalesce("volume", F.lit(0.0))).over(before), F.lit(0.0)),
            "pct_chg": F.coalesce((F.try_divide("close", F.lag("close").over(W())) - 1) * 100, F.lit(0.0)),
        }
    )
    df = df.where((F.col("date") == F.lit(trade_date)) & (F.col("n") >= 20))
    df = df.withColumns({"_br": F.coalesce(F.try_divide("close", "high_before"), F.lit(0.0)), "_vr": F.coalesce(F.try_divide("volume", "_volume"), F.lit(0.0)), "days_since_listed": F.coalesce(F.greatest(F.datediff(F.lit(trade_date), "list_date"), F.lit(0)), F.lit(9999))})
    br, vr = F.col("_br"), F.col("_vr")
    aligned = (F.col("ma5") >= F.col("ma10")) & (F.col("ma10") >= F.col("ma20"))
    trend = F.when(F.col("close") >= F.col("ma20"), 25.0).otherwise(0.0) + F.when(aligned, 45.0).otherwise(0.0) + F.when(br >= 1, 15.0).when(br >= 0.995, 10.0).otherwise(0.0)
    liquidity = F.least(F.least(F.col("_amount") / 1e6, F.lit(80.0)) + F.least(vr * 10, F.lit(20.0)), F.lit(100.0))
    flags = F.filter(F.array(F.when(F.col("is_st"), "st"), F.when(F.col("days_since_listed") < min_list_days, "new_listing"), F.when(vr < 1, "low_volume"), F.when(br < 0.98, "far_from_breakout")), lambda x: x.isNotNull())
    return df.select(
        F.lit(trade_date).alias("trade_date"), "code", "name", "close", "ma5", "ma10", "ma20", "ma60", "pct_chg", "is_st", "days_since_listed",
        half_up(vr, 4).alias("volume_ratio"), half_up(F.col("_amount"), 2).alias("avg_amount"), half_up(br, 4).alias("breakout_ratio"),
        half_up(F.least(vr * 2, F.lit(100.0)), 4).alias("turnover_rate"), trend.alias("trend_score"), half_up(liquidity, 2).alias("liquidity_score"), flags.alias("risk_flags"),
    )


def screen(snapshot: DataFrame, min_list_days: int = 120, min_avg_amount: float = 20_000.0, min_volume_ratio: float = 1.0) -> DataFrame:
    """Adds rejection reasons, rule hits, rule_score and the rank among those without reasons (ties by code)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    aligned = (n("close") >= n("ma20")) & (n("ma5") >= n("ma10")) & (n("ma10") >= n("ma20")) & (n("ma20") > 0)
    lively, liquid, near = n("volume_ratio") >= min_volume_ratio, n("avg_amount") >= min_avg_amount, n("breakout_ratio") >= 0.995
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    reasons = some(F.when(F.col("is_st"), "st_filtered"), F.when(n("days_since_listed") < min_list_days, "listed_days_below_threshold"), F.when(~liquid, "liquidity_below_threshold"), F.when(~aligned, "trend_not_aligned"), F.when(~lively, "volume_below_threshold"))
    hits = some(F.when(aligned, "trend_aligned"), F.when(lively, "volume_expanding"), F.when(near, "near_breakout"), F.when(liquid, "liquidity_ok"))
    score = sum((F.when(c, float(p)).otherwise(0.0) for c, p in ((aligned, 40), (lively, 30), (near, 20), (liquid, 10))), F.lit(0.0))
    score = score + F.greatest(n("breakout_ratio") - 1, F.lit(0.0)) * 1000 + F.least(n("volume_ratio"), F.lit(3.0))
    df = snapshot.withColumns({"reasons": reasons, "rule_hits": hits, "rule_score": half_up(score, 2)})
    # what is ranked is one day's survivors, a row for each symbol of a market at most
    rank = F.row_number().over(Window.partitionBy(F.size("reasons") == 0).orderBy(F.desc("rule_score"), "code"))
    return df.withColumn("rank", F.when(F.size("reasons") == 0, rank))


# What advice adds to a score.
AI_BONUS = {"strong_buy": 8, "buy": 6, "add": 4, "hold": 2, "wait": 0, "reduce": -4, "sell": -8}


def final_rank(candidates: DataFrame, advice: DataFrame, news: DataFrame, limit: int) -> DataFrame:
    """candidates: code, rule_score; advice: code, advice; news: code, a row for each item. Re-ranked, then limited."""
    bonus: Column = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in AI_BONUS.items() for x in kv)), F.col("advice")), F.lit(0))
    counts = news.groupBy("code").agg(F.count("*").alias("news_count"))
    df = candidates.join(advice, "code", "left").join(counts, "code", "left")
    df = df.withColumn("final_score", F.col("rule_score") + bonus + F.least(F.coalesce("news_count", F.lit(0)), F.lit(3)))
    df = df.orderBy(F.desc("final_score"), "code").limit(limit)
    return df.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "code")))  # after the limit


def sync_health(expected: DataFrame, bars: DataFrame, trade_date: datetime.date, most_missing: float = 0.02) -> DataFrame:
    """One row: expected, available, missing symbols on trade_date, their rates, and whether too many are missing."""
    there = bars.where(F.col("date") == F.lit(trade_date)).select("code", F.lit(1).alias("there"))
    df = expected.select("code").distinct().join(there, "code", "left")
    out = df.agg(F.count("*").alias("expected"), F.count("there").alias("available"))
    missing = F.col("expected") - F.col("available")
    return out.select("expected", "available", missing.alias("missing"), half_up(F.coalesce(F.try_divide("available", "expected"), F.lit(0.0)), 4).alias("available_rate"), (F.try_divide(missing, "expected") > most_missing).alias("blocked"))
