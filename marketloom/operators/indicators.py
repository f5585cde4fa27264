"""Indicators over daily bars of all symbols at once. Every window is partitioned by code and ordered by date, so one sort
serves them all. NaN is turned to null at the edge; a symbol's bars are unique by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def BY_CODE() -> WindowSpec:  # noqa: N802  windows need a session, so they are made when asked for
    return Window.partitionBy("code")


def W() -> WindowSpec:  # noqa: N802
    return BY_CODE().orderBy("date")


#: EMA block: what is older than a block weighs less than a double can tell, for any span up to 60.
EMA_BLOCK = 1000


def back(n: int, to: int = 0):
    """The frame from n rows back."""
    return W().rowsBetween(-n, to)


def sma(c: str, n: int) -> Column:
    """Mean of the last n rows; null until there are n."""
    return F.when(F.count(c).over(back(n - 1)) == n, F.avg(c).over(back(n - 1)))


def moving_averages(bars: DataFrame) -> DataFrame:
    """ma5, ma10, ma20 strictly; ma60, or ma20 for the whole series of a symbol with fewer than 60 bars."""
    out = bars.withColumns({f"ma{n}": sma("close", n) for n in (5, 10, 20, 60)})
    return out.withColumn("ma60", F.when(F.count("*").over(BY_CODE()) >= 60, F.col("ma60")).otherwise(F.col("ma20")))


def lenient_averages(bars: DataFrame) -> DataFrame:
    """Averages over what there is, and the stored volume ratio against the five bars before."""
    before = F.avg("volume").over(W().rowsBetween(-5, -1))
    out = bars.withColumns({f"ma{n}": F.avg("close").over(back(n - 1)) for n in (5, 10, 20)})
    return out.withColumn("volume_ratio", F.when(before.isNull() | ((before == 0) & (F.col("volume") == 0)), F.lit(1.0)).otherwise(F.try_divide("volume", before)))


def pct_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pct_chg", F.coalesce((F.try_divide("close", F.lag("close").over(W())) - 1) * 100, F.lit(0.0)))


def emas(df: DataFrame, means: Sequence[tuple[str, int, str]]) -> DataFrame:
    """means: (source, span, name of the result). Recursive means y = a x + (1 - a) y', from the first value, as weighted
    running sums, all in the same windows. Sums restart at each block, and the block before gives the start, so weights stay in
    range however long a series is."""
    i = F.row_number().over(W()) - 1
    df = df.withColumn("_i", i).withColumn("_b", F.floor(F.col("_i") / EMA_BLOCK).cast("int"))
    k = F.col("_i") - F.col("_b") * EMA_BLOCK
    block = Window.partitionBy("code", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code").orderBy("_b").rangeBetween(-1, -1)
    sums, starts, ends = {}, {}, {}
    for source, span, to in means:
        a = 2.0 / (span + 1)
        b = 1.0 - a
        term = F.when(F.col("_i") == 0, F.col(source)).otherwise(F.lit(a) * F.col(source) * F.pow(F.lit(b), -k))
        sums[f"_z_{to}"] = F.sum(term).over(block) * F.pow(F.lit(b), k)
        starts[f"_s_{to}"] = F.max_by(f"_z_{to}", "_i").over(before)
        ends[to] = F.col(f"_z_{to}") + F.when(F.col("_b") > 0, F.pow(F.lit(b), k + 1) * F.col(f"_s_{to}")).otherwise(0.0)
    return df.withColumns(sums).withColumns(starts).withColumns(ends).drop("_i", "_b", *sums, *starts)


def ema(df: DataFrame, source: str, span: int, to: str) -> DataFrame:
    return emas(df, [(source, span, to)])


def macd(bars: DataFrame) -> DataFrame:
    df = emas(bars, [("close", 12, "_fast"), ("close", 26, "_slow")]).withColumn("dif", F.col("_fast") - F.col("_slow"))
    return ema(df, "dif", 9, "dea").withColumn("bar", 2 * (F.col("dif") - F.col("dea"))).drop("_fast", "_slow")


def macd_status(df: DataFrame) -> DataFrame:
    """Adds macd_status; symbols with fewer than 26 bars are BULLISH by default."""
    gap, before = F.col("dif") - F.col("dea"), F.lag(F.col("dif") - F.col("dea")).over(W())
    zero = F.lag("dif").over(W())
    golden, death = (before <= 0) & (gap > 0), (before >= 0) & (gap < 0)
    status = (
        F.when(F.row_number().over(W()) < 26, "BULLISH")
        .when(golden & (F.col("dif") > 0), "GOLDEN_CROSS_ZERO")
        .when((zero <= 0) & (F.col("dif") > 0), "CROSSING_UP")
        .when(golden, "GOLDEN_CROSS")
        .when(death, "DEATH_CROSS")
        .when((zero >= 0) & (F.col("dif") < 0), "CROSSING_DOWN")
        .when((F.col("dif") > 0) & (F.col("dea") > 0), "BULLISH")
        .when((F.col("dif") < 0) & (F.col("dea") < 0), "BEARISH")
        .otherwise("BULLISH")
    )
    return df.withColumn("macd_status", status)


def rsi(bars: DataFrame, spans: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Simple-mean RSI; the first bar counts as no change; 50 until n bars or when nothing moves."""
    change = F.coalesce(F.col("close") - F.lag("close").over(W()), F.lit(0.0))
    df = bars.withColumns({"_g": F.greatest(change, F.lit(0.0)), "_l": F.greatest(-change, F.lit(0.0))})
    for n in spans:
        g, l = F.avg("_g").over(back(n - 1)), F.avg("_l").over(back(n - 1))
        df = df.withColumn(f"rsi{n}", F.when((F.row_number().over(W()) < n) | ((g < 1e-12) & (l < 1e-12)), 50.0).when(l < 1e-12, 100.0).otherwise(100 - 100 / (1 + F.try_divide(g, l))))
    return df.drop("_g", "_l")


def rsi_status(df: DataFrame) -> DataFrame:
    r = F.col("rsi12")
    return df.withColumn("rsi_status", F.when(F.row_number().over(W()) < 24, "NEUTRAL").when(r > 70, "OVERBOUGHT").when(r > 60, "STRONG_BUY").when(r >= 40, "NEUTRAL").when(r >= 30, "WEAK").otherwise("OVERSOLD"))


def trend_status(df: DataFrame) -> DataFrame:
    """Adds trend_status and trend_strength to moving_averages(); null before 20 bars."""
    up, down = F.try_divide((F.col("ma5") - F.col("ma20")) * 100, "ma20"), F.try_divide((F.col("ma20") - F.col("ma5")) * 100, "ma5")
    wider_up = (up > F.lag(up, 4).over(W())) & (up > 5)
    wider_down = (down > F.lag(down, 4).over(W())) & (down > 5)
    a, b, c = F.col("ma5"), F.col("ma10"), F.col("ma20")
    status = (
        F.when(c.isNull(), None)
        .when((a > b) & (b > c), F.when(wider_up, "STRONG_BULL").otherwise("BULL"))
        .when(a > b, "WEAK_BULL")
        .when((a < b) & (b < c), F.when(wider_down, "STRONG_BEAR").otherwise("BEAR"))
        .when(a < b, "WEAK_BEAR")
        .otherwise("CONSOLIDATION")
    )
    strength = F.create_map(*(F.lit(x) for kv in {"STRONG_BULL": 90, "BULL": 75, "WEAK_BULL": 55, "CONSOLIDATION": 50, "WEAK_BEAR": 40, "BEAR": 25, "STRONG_BEAR": 10}.items() for x in kv))
    return df.withColumn("trend_status", status).withColumn("trend_strength", F.element_at(strength, F.col("trend_status")))


def volume_status(df: DataFrame) -> DataFrame:
    """Adds volume_ratio_5d (against the five bars before; 0 if they have none) and volume_status."""
    before = F.avg("volume").over(W().rowsBetween(-5, -1))
    ratio = F.when((F.row_number().over(W()) >= 5) & (before > 0), F.col("volume") / before).otherwise(0.0)
    rose = F.col("close") > F.lag("close").over(W())
    df = df.withColumn("volume_ratio_5d", ratio)
    r = F.col("volume_ratio_5d")
    return df.withColumn("volume_status", F.when(F.row_number().over(W()) < 5, "NORMAL").when(r >= 1.5, F.when(rose, "HEAVY_UP").otherwise("HEAVY_DOWN")).when(r <= 0.7, F.when(rose, "SHRINK_UP").otherwise("SHRINK_DOWN")).otherwise("NORMAL"))


def support_resistance(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Adds support_ma5, support_ma10, support_ma20 and resistance (20-bar high with today, if above the close)."""
    near = lambda m: F.coalesce((F.abs(F.col("close") - F.col(m)) / F.col(m) <= tolerance) & (F.col("close") >= F.col(m)), F.lit(False))
    high = F.max("high").over(back(19))
    return df.withColumns({"support_ma5": near("ma5"), "support_ma10": near("ma10"), "support_ma20": F.coalesce(F.col("close") >= F.col("ma20"), F.lit(False)), "resistance": F.when((F.count("*").over(back(19)) == 20) & (high > F.col("close")), high)})


# Points of the signal score.
TREND_POINTS = {"STRONG_BULL": 30, "BULL": 26, "WEAK_BULL": 18, "CONSOLIDATION": 12, "WEAK_BEAR": 8, "BEAR": 4, "STRONG_BEAR": 0}
VOLUME_POINTS = {"SHRINK_DOWN": 15, "HEAVY_UP": 12, "NORMAL": 10, "SHRINK_UP": 6, "HEAVY_DOWN": 0}
MACD_POINTS = {"GOLDEN_CROSS_ZERO": 15, "GOLDEN_CROSS": 12, "CROSSING_UP": 10, "BULLISH": 8, "BEARISH": 2, "CROSSING_DOWN": 0, "DEATH_CROSS": 0}
RSI_POINTS = {"OVERSOLD": 10, "STRONG_BUY": 8, "NEUTRAL": 5, "WEAK": 3, "OVERBOUGHT": 0}
BIAS_THRESHOLD = 5.0


def points(column: str, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column))


def trend_signal(bars: DataFrame, threshold: float = BIAS_THRESHOLD) -> DataFrame:
    """Status columns, bias, signal_score, buy_signal and reasons for every bar from a symbol's 20th."""
    df = support_resistance(volume_status(trend_status(rsi_status(rsi(macd_status(macd(moving_averages(bars))))))))
    df = df.where("ma20 is not null").withColumn("bias_ma5", F.coalesce(F.try_divide((F.col("close") - F.col("ma5")) * 100, "ma5"), F.lit(0.0)))
    bias, strong = F.col("bias_ma5"), F.col("trend_status") == "STRONG_BULL"
    bound = F.when(strong, threshold * 1.5).otherwise(threshold)
    bias_points = (
        F.when(bias < 0, F.when(bias > -3, 20).when(bias > -5, 16).otherwise(8))
        .when(bias < 2, 18).when(bias < threshold, 14).when(bias > bound, 4).when((bias > threshold) & strong, 10).otherwise(4)
    )
    score = points("trend_status", TREND_POINTS) + bias_points + points("volume_status", VOLUME_POINTS) + F.col("support_ma5").cast("int") * 5 + F.col("support_ma10").cast("int") * 5 + points("macd_status", MACD_POINTS) + points("rsi_status", RSI_POINTS)
    df = df.withColumn("signal_score", score)
    s, t = F.col("signal_score"), F.col("trend_status")
    signal = (
        F.when((s >= 75) & t.isin("STRONG_BULL", "BULL"), "STRONG_BUY")
        .when((s >= 60) & t.isin("STRONG_BULL", "BULL", "WEAK_BULL"), "BUY")
        .when(s >= 45, "HOLD")
        .when(s >= 30, "WAIT")
        .when(t.isin("BEAR", "STRONG_BEAR"), "STRONG_SELL")
        .otherwise("SELL")
    )
    reasons = F.filter(
        F.array(
            F.when(t.isin("STRONG_BULL", "BULL"), "trend"),
            F.when((bias > -5) & (bias < threshold), "bias"),
            F.when(F.col("volume_status") == "SHRINK_DOWN", "volume"),
            F.when(F.col("support_ma5"), "support_ma5"),
            F.when(F.col("support_ma10"), "support_ma10"),
            F.when(F.col("macd_status").startswith("GOLDEN"), "macd"),
            F.when(F.col("rsi_status").isin("OVERSOLD", "STRONG_BUY"), "rsi"),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumns({"buy_signal": signal, "reasons": reasons})


def latest(df: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    return df.withColumn("_r", F.row_number().over(BY_CODE().orderBy(F.desc("date")))).where("_r = 1").drop("_r")


def calculate_ma(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 30, 60, 120, 250)) -> DataFrame:
    """Of each symbol's last bar: the averages of the last n closes (null with fewer) and how many the close is above."""
    df = latest(bars.withColumns({f"ma{n}": sma("close", n) for n in periods}))
    above = sum(F.coalesce((F.col("close") > F.col(f"ma{n}")).cast("int"), F.lit(0)) for n in periods)
    return df.select("code", "close", *(f"ma{n}" for n in periods), above.alias("above"))


def volume_analysis(bars: DataFrame, days: int = 30) -> DataFrame:
    """Volume and price over each symbol's last bars; here the five-bar mean includes the last bar."""
    n = F.row_number().over(BY_CODE().orderBy(F.desc("date")))
    df = bars.withColumn("n", n).where(F.col("n") <= days)
    df = df.withColumn("up", F.coalesce(F.col("close") > F.lag("close").over(W()), F.lit(False)))
    df = df.withColumn("m20", F.avg(F.when(F.col("n") <= 20, F.col("volume"))).over(BY_CODE())).withColumn("m10", F.avg(F.when(F.col("n") <= 10, F.col("volume"))).over(BY_CODE()))
    df = df.withColumn("m20", F.when(F.count("*").over(BY_CODE()) >= 20, F.col("m20")).otherwise(F.col("m10")))
    g = df.groupBy("code").agg(
        F.count("*").alias("period_days"),
        F.max(F.when(F.col("n") == 1, F.col("volume"))).alias("latest_volume"),
        F.avg(F.when(F.col("n") <= 5, F.col("volume"))).alias("avg_volume_5d"),
        F.max("m20").alias("avg_volume_20d"),
        F.coalesce(F.avg(F.when(F.col("up"), F.col("volume"))), F.lit(0.0)).alias("avg_up"),
        F.coalesce(F.avg(F.when(~F.col("up"), F.col("volume"))), F.lit(0.0)).alias("avg_down"),
        F.avg(F.when(F.col("n").between(6, 10), F.col("volume"))).alias("prior"),
        F.count_if(F.col("volume") > F.col("m20") * 2).cast("int").alias("high_volume_days"),
        F.corr("volume", "close").alias("volume_price_corr"),
    )
    g = g.where("period_days >= 5").withColumns({"ratio_5d": F.try_divide("latest_volume", "avg_volume_5d"), "trend_pct": F.when(F.col("period_days") >= 10, F.coalesce(F.try_divide((F.col("avg_volume_5d") - F.col("prior")) * 100, "prior"), F.lit(0.0))).otherwise(0.0)})
    trend = F.when(F.col("period_days") < 10, "数据不足").when(F.col("trend_pct") > 20, "放量").when(F.col("trend_pct") < -20, "缩量").otherwise("量能平稳")
    pattern = F.when(F.col("avg_up") > F.col("avg_down") * 1.3, "healthy").when(F.col("avg_down") > F.col("avg_up") * 1.3, "divergent").when(F.col("ratio_5d") > 1.5, "expanding").when(F.col("ratio_5d") < 0.6, "shrinking").otherwise("neutral")
    return g.withColumns({"volume_trend": trend, "pattern": pattern}).drop("prior")


def candle_patterns(bars: DataFrame, days: int = 60) -> DataFrame:
    """code, pattern, offset (bars back from the last): shapes of each symbol's last bars, each name once, the latest kept."""
    n = F.row_number().over(BY_CODE().orderBy(F.desc("date")))
    df = bars.withColumn("n", n).where(F.col("n") <= days).withColumn("size", F.count("*").over(BY_CODE()))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    df = df.withColumns({"body": F.abs(F.col("close") - F.col("open")), "us": F.col("high") - top, "ls": bottom - F.col("low"), "bull": F.col("close") > F.col("open"), "bear": F.col("close") < F.col("open")})
    df = df.withColumn("mean_body", F.avg("body").over(BY_CODE()))
    lag = lambda c, k=1: F.lag(c, k).over(W())
    body, m, last, o, c = F.col("body"), F.col("mean_body"), F.col("n") == 1, F.col("open"), F.col("close")
    recent, middle = F.col("n") <= 3, (lag("open", 2) + lag("close", 2)) / 2
    df = df.withColumns({"pc": lag("close"), "star": (lag("body", 2) > m * 1.5) & (lag("body") < m * 0.4) & (body > m * 1.5) & last & (F.col("size") >= 3)})
    bull_engulf = last & (F.col("size") >= 3) & F.col("bull") & lag("bear") & (o < lag("close")) & (c > lag("open"))
    bear_engulf = last & (F.col("size") >= 3) & F.col("bear") & lag("bull") & (o > lag("close")) & (c < lag("open"))
    box = last & (F.col("size") >= 10) & (F.coalesce(F.try_divide((F.max("high").over(back(9)) - F.min("low").over(back(9))) * 100, F.min("low").over(back(9))), F.lit(0.0)) < 8)
    breakout = last & (F.col("size") >= 21) & (c > F.max("high").over(W().rowsBetween(-20, -1))) & (F.col("volume") > F.avg("volume").over(W().rowsBetween(-5, -1)) * 1.5)
    shape = lambda name, when, at: F.when(when, F.struct(F.lit(name).alias("pattern"), at.alias("offset")))
    here = (1 - F.col("n")).cast("int")
    fixed = lambda k: F.lit(k)
    shapes = F.array(
        shape("doji", recent & (body < m * 0.1) & (F.col("us") + F.col("ls") > body * 3), here),
        shape("hammer", recent & (F.col("ls") > body * 2) & (F.col("us") < body * 0.5) & (F.col("pc").isNull() | (c >= F.col("pc"))), here),
        shape("hanging man", recent & (F.col("ls") > body * 2) & (F.col("us") < body * 0.5) & (c < F.col("pc")), here),
        shape("shooting star", recent & (F.col("us") > body * 2) & (F.col("ls") < body * 0.5) & F.col("bear"), here),
        shape("inverted hammer", recent & (F.col("us") > body * 2) & (F.col("ls") < body * 0.5) & ~F.col("bear"), here),
        shape("big up", recent & (body > m * 2.5) & F.col("bull"), here),
        shape("big down", recent & (body > m * 2.5) & ~F.col("bull"), here),
        shape("morning star", F.col("star") & lag("bear", 2) & F.col("bull") & (c > middle), fixed(-2)),
        shape("evening star", F.col("star") & lag("bull", 2) & F.col("bear") & (c < middle), fixed(-2)),
        shape("bullish engulfing", bull_engulf, fixed(-1)),
        shape("bearish engulfing", bear_engulf & ~F.coalesce(bull_engulf, F.lit(False)), fixed(-1)),
        shape("breakout", breakout, fixed(0)),
        shape("box", box, fixed(0)),
    )
    found = df.select("code", "date", shapes.alias("shapes"))
    found = found.select("code", "date", F.explode(F.filter("shapes", lambda x: x.isNotNull())).alias("x")).select("code", "date", "x.*")
    newest = found.withColumn("_r", F.row_number().over(Window.partitionBy("code", "pattern").orderBy(F.desc("date")))).where("_r = 1")
    return newest.select("code", "pattern", "offset").unionByName(double_bottom(bars, days).select("code", F.lit("double bottom").alias("pattern"), "offset"))


def double_bottom(bars: DataFrame, days: int = 60) -> DataFrame:
    """code, offset, low1, low2: the two lowest lows (the earlier first among equals) at least five bars apart, within 3 % of
    each other, with a high between them more than 3 % above the first."""
    n = F.row_number().over(BY_CODE().orderBy(F.desc("date")))
    df = bars.withColumn("n", n).where(F.col("n") <= days).withColumn("k", F.row_number().over(BY_CODE().orderBy("low", F.desc("n"))))
    pair = df.where("k <= 2").groupBy("code").agg(F.max("n").alias("n1"), F.min("n").alias("n2"), F.max_by("low", "n").alias("low1"), F.min_by("low", "n").alias("low2"))
    pair = pair.where((F.col("n1") - F.col("n2") >= 5) & (F.abs(F.col("low1") - F.col("low2")) / F.greatest("low1", "low2") < 0.03))
    between = df.select("code", "n", "high").join(pair, "code").where("n between n2 and n1")
    return between.groupBy("code", "n1", "n2", "low1", "low2").agg(F.max("high").alias("high")).where(F.col("high") > F.col("low1") * 1.03).select("code", (1 - F.col("n2")).cast("int").alias("offset"), "low1", "low2")


def rule_strategies(bars: DataFrame) -> DataFrame:
    """code, date, strategy: the strategies of averages and volumes that each bar meets; strategies.py has those of shapes."""
    df = moving_averages(bars)
    prev5 = F.avg("volume").over(W().rowsBetween(-5, -1))
    df = df.withColumns({"ratio": F.try_divide("volume", prev5), "bias": F.try_divide((F.col("close") - F.col("ma5")) * 100, "ma5"), "hi20": F.max("high").over(W().rowsBetween(-20, -1)), "above": (F.col("ma5") > F.col("ma10")).cast("int")})
    df = df.withColumns({"cross": (F.col("above") == 1) & (F.lag("above").over(W()) == 0), "ma20_before": F.lag("ma20", 5).over(W()), "top": F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})
    df = df.withColumn("crossed", F.max(F.col("cross").cast("int")).over(back(2)) == 1)
    c = F.col
    near = lambda m, t: F.abs(c("close") - c(m)) / c(m) <= t
    rules = {
        "ma_golden_cross": c("crossed") & (c("ratio") > 1.2) & (c("bias") < 5),
        "shrink_pullback": (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (near("ma5", 0.01) | near("ma10", 0.02)) & (c("ratio") < 0.7),
        "volume_breakout": (c("ratio") > 2) & (c("close") > c("hi20")) & (c("top") >= 0.7) & (c("bias") < 5),
        "bottom_volume": (c("close") <= c("hi20") * 0.85) & (c("ratio") > 3) & (c("close") > c("open")),
        "bull_trend": (c("ma5") >= c("ma10")) & (c("ma10") >= c("ma20")) & (c("ma20") > c("ma20_before")),
    }
    met = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return df.select("code", "date", F.explode(met).alias("strategy"))
