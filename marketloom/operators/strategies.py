"""Strategies that look at more than one bar and its averages, and which strategies a market regime asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strategies of each regime, and of none.
REGIMES = {
    "trending_up": ("bull_trend", "volume_breakout", "ma_golden_cross"),
    "trending_down": ("shrink_pullback", "bottom_volume"),
    "sideways": ("box_oscillation", "shrink_pullback"),
    "volatile": ("chan_theory", "wave_theory"),
    "sector_hot": ("dragon_head", "emotion_cycle"),
}
DEFAULT = ("bull_trend", "shrink_pullback")


def boxes(bars: DataFrame, most: int = 120, least: int = 60, band: float = 0.05, touches: int = 2) -> DataFrame:
    """code, top, bottom, top_touches, bottom_touches, zone of each symbol whose last bars (`most`, at least `least`) form a
    box. The edges are the highest high and lowest low; a touch is a visit to the band below or above them, however many bars
    it lasts; each edge has `touches` of them, and the bands do not meet. zone is where the last close is."""
    w = Window.partitionBy("code")
    df = bars.withColumn("n", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("n") <= most)
    df = df.withColumns({"size": F.count("*").over(w), "top": F.max("high").over(w), "bottom": F.min("low").over(w)}).where(F.col("size") >= least)
    df = df.withColumns({"up": F.col("high") >= F.col("top") * (1 - band), "down": F.col("low") <= F.col("bottom") * (1 + band)})
    before = lambda c: F.coalesce(F.lag(c).over(w.orderBy("date")), F.lit(False))
    df = df.withColumns({"up": F.col("up") & ~before("up"), "down": F.col("down") & ~before("down")})
    g = df.groupBy("code", "top", "bottom").agg(F.count_if("up").alias("top_touches"), F.count_if("down").alias("bottom_touches"), F.max(F.when(F.col("n") == 1, F.col("close"))).alias("close"))
    g = g.where((F.col("top_touches") >= touches) & (F.col("bottom_touches") >= touches) & (F.col("bottom") * (1 + band) < F.col("top") * (1 - band)))
    third = (F.col("top") - F.col("bottom")) / 3
    zone = F.when(F.col("close") <= F.col("bottom") * (1 + band), "bottom").when(F.col("close") >= F.col("top") * (1 - band), "top").when(F.col("close").between(F.col("bottom") + third, F.col("top") - third), "middle").otherwise("between")
    return g.select("code", "top", "bottom", "top_touches", "bottom_touches", zone.alias("zone"))


def one_yang_three_yin(bars: DataFrame, body: float = 0.02, shrink: float = 0.8) -> DataFrame:
    """code, date of bars that end the pattern: a large rise, three small bars or falls that stay above its open, close within
    its body, trade less than `shrink` of its volume and each less than the bar before, then a rise above its close."""
    w = Window.partitionBy("code").orderBy("date")
    bar = F.struct("open", "high", "low", "close", "volume")
    df = bars.select("code", "date", bar.alias("b"), *(F.lag(bar, k).over(w).alias(f"b{k}") for k in (4, 3, 2, 1)))
    first, last = F.col("b4"), F.col("b")
    rise = (first["close"] > first["open"]) & ((first["close"] - first["open"]) / first["open"] > body)
    inside = rise
    for k in (3, 2, 1):
        b, before = F.col(f"b{k}"), F.col(f"b{k + 1}")
        small = (b["close"] < b["open"]) | (F.abs(b["close"] - b["open"]) / b["open"] <= body)
        inside = inside & small & (b["low"] >= first["open"]) & b["close"].between(first["open"], first["close"]) & (b["volume"] < first["volume"] * shrink) & (b["volume"] < before["volume"])
    return df.where(inside & (last["close"] > last["open"]) & (last["close"] > first["close"])).select("code", "date")


def dragon_heads(day: DataFrame, turnover: float = 5.0, ratio: float = 1.5, ahead: float = 2.0, bias: float = 7.0) -> DataFrame:
    """day: code, sector, turnover_rate, volume_ratio, pct_chg, bias. Those that lead a sector: lively, rising by `ahead` more
    than the sector's mean, and not too far above their average."""
    df = day.withColumn("sector_mean", F.avg("pct_chg").over(Window.partitionBy("sector")))
    lead = F.col("pct_chg") - F.col("sector_mean")
    keep = (F.col("turnover_rate") > turnover) & (F.col("volume_ratio") > ratio) & (F.col("pct_chg") > 0) & (lead >= ahead) & (F.col("bias") <= bias)
    return df.where(keep).select("code", "sector", lead.alias("lead"))


def emotion_cycle(bars: DataFrame, year: int = 250) -> DataFrame:
    """bars: code, date, close, volume, turnover_rate (percent). Of each symbol's last bar: the heat of its turnover, and how
    many marks of an emotional bottom and top it has.

    Bottom: turnover's 20-bar mean within a tenth of the year's lowest; volume's 20-bar mean below half of the 60-bar mean;
    close at most 2 % above its 20-bar mean. Top: turnover's 5-bar mean above twice the 20-bar mean; volume five times the
    mean of the 20 bars before; close more than 8 % above its 5-bar mean."""
    w = Window.partitionBy("code").orderBy("date")
    mean = lambda c, n, to=0: F.avg(c).over(w.rowsBetween(to - n + 1, to))
    df = bars.withColumns({"t5": mean("turnover_rate", 5), "t20": mean("turnover_rate", 20), "v20": mean("volume", 20), "v60": mean("volume", 60), "v_before": mean("volume", 20, -1), "m5": mean("close", 5), "m20": mean("close", 20), "r": F.row_number().over(w)})
    df = df.withColumn("least", F.min(F.when(F.col("r") >= 20, F.col("t20"))).over(w.rowsBetween(1 - year, 0)))
    df = df.withColumn("last", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where((F.col("last") == 1) & (F.col("r") >= 60))
    t, count = F.col("turnover_rate"), lambda *cs: sum((F.coalesce(c, F.lit(False)).cast("int") for c in cs), F.lit(0))
    heat = F.when(t < 0.5, "cold").when(t < 2, "calm").when(t < 5, "active").when(t <= 10, "hot").otherwise("overheated")
    bottom = count(F.col("t20") <= F.col("least") * 1.1, F.col("v20") < F.col("v60") * 0.5, F.col("close") <= F.col("m20") * 1.02)
    top = count(F.col("t5") > F.col("t20") * 2, F.col("volume") > F.col("v_before") * 5, F.col("close") > F.col("m5") * 1.08)
    return df.select("code", heat.alias("heat"), bottom.alias("bottom_marks"), top.alias("top_marks"))


def regime(alignment: Column, score: Column, volume: Column, sector_hot: Column) -> Column:
    """The regime that the technical opinion shows, the first that fits; null if none does."""
    a, v, s = F.lower(F.coalesce(alignment, F.lit(""))), F.lower(F.coalesce(volume, F.lit(""))), F.coalesce(score.cast("double"), F.lit(50.0))
    return (
        F.when((a == "bullish") & (s >= 70), "trending_up").when((a == "bearish") & (s <= 30), "trending_down").when((a == "neutral") | s.between(35, 65), "sideways")
        .when((v == "heavy") & (s > 30) & (s < 70), "volatile").when(F.coalesce(sector_hot, F.lit(False)), "sector_hot")
    )


def routed(regime_: Column, requested: Column, available: Sequence[str], most: int = 3) -> Column:
    """Strategies to run, in order: those asked for, else the regime's that are available, else the default."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    of = F.element_at(F.create_map(*(x for k, v in REGIMES.items() for x in (F.lit(k), strings([s for s in v if s in available][:most])))), F.coalesce(regime_, F.lit("")))
    return F.when(F.size(F.coalesce(requested, strings([]))) > 0, F.slice(requested, 1, most)).when(F.size(of) > 0, of).otherwise(strings(DEFAULT[:most]))
