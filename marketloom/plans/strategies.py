"""Queries on strategies of shapes, sectors and emotions, and on their routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.operators import strategies as st
from marketloom.operators.indicators import lenient_averages, pct_change
from marketloom.plans.registry import query
from marketloom.sources.testdata import BARS, INSTRUMENTS, MONTHLY_BARS, bars, instruments, table

W = "PARTITION BY code ORDER BY date"
PRICES = ("open", "high", "low", "close")
BOX = f"""{BARS}, calm AS (SELECT code, date, high / 100 + 50 AS high, low / 100 + 50 AS low, close / 100 + 50 AS close FROM bars), l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM calm), b AS (SELECT *, max(high) OVER (PARTITION BY code) AS top, min(low) OVER (PARTITION BY code) AS bottom, count(*) OVER (PARTITION BY code) AS size FROM l WHERE n <= 120),
  u AS (SELECT *, high >= top * (1 - 0.05::DOUBLE) AS up, low <= bottom * (1 + 0.05::DOUBLE) AS down FROM b WHERE size >= 60), v AS (SELECT *, up AND NOT coalesce(lag(up) OVER ({W}), false) AS tu, down AND NOT coalesce(lag(down) OVER ({W}), false) AS td FROM u),
  g AS (SELECT code, top, bottom, count(*) FILTER (WHERE tu) AS top_touches, count(*) FILTER (WHERE td) AS bottom_touches, max(close) FILTER (WHERE n = 1) AS close FROM v GROUP BY code, top, bottom)"""


@query(f"""WITH {BOX} SELECT code, top, bottom, top_touches, bottom_touches, CASE WHEN close <= bottom * (1 + 0.05::DOUBLE) THEN 'bottom' WHEN close >= top * (1 - 0.05::DOUBLE) THEN 'top' WHEN close BETWEEN bottom + (top - bottom) / 3 AND top - (top - bottom) / 3 THEN 'middle' ELSE 'between' END AS zone
FROM g WHERE top_touches >= 2 AND bottom_touches >= 2 AND bottom * (1 + 0.05::DOUBLE) < top * (1 - 0.05::DOUBLE)""")
def box_oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's own band of 5 %, on prices that move a fifth at most."""
    return st.boxes(bars(spark, sf_dir).withColumns({c: F.col(c) / 100 + 50 for c in PRICES}))


#: How far the open and close of bars move within a cycle of five, and what share of their volume is traded.
CYCLE = {"open": (0.0, 1.8, 1.4, 1.0, 0.7), "close": (1.9, 1.5, 1.1, 0.8, 2.3), "volume": (5.0, 0.5, 0.25, 0.125, 2.0)}
_AT = lambda c: f"[{', '.join(f'{x}::DOUBLE' for x in CYCLE[c])}][n % 5 + 1]"
_B = lambda c, k: f"lag({c}, {k}) OVER ({W})"
_SMALL = " AND ".join(f"(c{k} < o{k} OR abs(c{k} - o{k}) / o{k} <= 0.02::DOUBLE) AND l{k} >= o4 AND c{k} BETWEEN o4 AND c4 AND v{k} < v4 * 0.8::DOUBLE AND v{k} < v{k + 1}" for k in (3, 2, 1))


@query(f"""WITH {BARS}, y AS (SELECT *, row_number() OVER ({W}) AS n FROM bars), z AS (SELECT code, date, open / 1000 + 50 + {_AT('open')} AS open, low / 1000 + 50 AS floor_, close / 1000 + 50 + {_AT('close')} AS close, volume * {_AT('volume')} AS volume FROM y), t AS (SELECT *, least(open, close, floor_ + 0.9::DOUBLE) AS low FROM z),
  x AS (SELECT code, date, open, close, {', '.join(f"{_B('open', k)} AS o{k}, {_B('low', k)} AS l{k}, {_B('close', k)} AS c{k}, {_B('volume', k)} AS v{k}" for k in (4, 3, 2, 1))} FROM t)
SELECT code, date FROM x WHERE c4 > o4 AND (c4 - o4) / o4 > 0.02::DOUBLE AND {_SMALL} AND close > open AND close > c4""")
def one_yang_three_yin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's own thresholds, on bars that rise, rest and rise; whether the shape holds is up to the bars' own prices and
    volumes."""
    from pyspark.sql import Window

    at = lambda c: F.element_at(F.array(*map(F.lit, CYCLE[c])), (F.col("n") % 5 + 1).cast("int"))
    df = bars(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("date")))
    df = df.withColumns({"open": F.col("open") / 1000 + 50 + at("open"), "close": F.col("close") / 1000 + 50 + at("close"), "volume": F.col("volume") * at("volume")})
    df = df.withColumn("low", F.least("open", "close", F.col("low") / 1000 + 50 + 0.9)).withColumn("high", F.greatest("open", "close"))
    return st.one_yang_three_yin(df)


@query(f"""WITH {MONTHLY_BARS}, {INSTRUMENTS}, p AS (SELECT code, date, close / 100 + 50 AS close, volume FROM bars), x AS (SELECT *, avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma5, avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS vb, coalesce((close / lag(close) OVER ({W}) - 1) * 100, 0.0) AS pct FROM p),
  l AS (SELECT x.*, i.industry, volume / vb AS ratio, (close - ma5) * 100 / ma5 AS bias FROM x JOIN instruments i ON i.code = x.code WHERE vb > 0), s AS (SELECT *, avg(pct) OVER (PARTITION BY date, industry) AS mean FROM l), k AS (SELECT code, date, industry, pct - mean AS lead_ FROM s WHERE least(ratio * 4, 100.0) > 5 AND ratio > 1.5 AND pct > 0 AND pct - mean >= 2 AND bias <= 7)
SELECT code, date, industry, {R('lead_')} FROM k""")
def dragon_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries are sectors, in each month; turnover is made from the volume ratio."""
    from pyspark.sql import Window

    b = bars(spark, sf_dir, "month").withColumns({c: F.col(c) / 100 + 50 for c in PRICES})
    b = pct_change(lenient_averages(b)).withColumn("bias", (F.col("close") - F.col("ma5")) * 100 / F.col("ma5"))
    before = F.avg("volume").over(Window.partitionBy("code").orderBy("date").rowsBetween(-5, -1))
    b = b.withColumn("volume_ratio", F.col("volume") / before).where("volume_ratio is not null").withColumn("turnover_rate", F.least(F.col("volume_ratio") * 4, F.lit(100.0)))
    b = b.join(instruments(spark, sf_dir).select("code", "industry"), "code").withColumn("sector", F.struct("date", "industry"))
    return st.dragon_heads(b).select("code", "sector.date", "sector.industry", F.col("lead").alias("lead_")).select("code", "date", "industry", *r("lead_"))


_M = lambda c, n, to="CURRENT ROW", more=0: f"avg({c}) OVER ({W} ROWS BETWEEN {n - 1 + more} PRECEDING AND {to})"


@query(f"""WITH {BARS}, t AS (SELECT code, date, close, volume, volume / 40 AS turnover_rate FROM bars), x AS (SELECT *, {_M('turnover_rate', 5)} AS t5, {_M('turnover_rate', 20)} AS t20, {_M('volume', 20)} AS v20, {_M('volume', 60)} AS v60, {_M('volume', 20, '1 PRECEDING', 1)} AS vb, {_M('close', 5)} AS m5, {_M('close', 20)} AS m20, row_number() OVER ({W}) AS r FROM t),
  y AS (SELECT *, min(CASE WHEN r >= 20 THEN t20 END) OVER ({W} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS least_, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS last_ FROM x)
SELECT code, CASE WHEN turnover_rate < 0.5 THEN 'cold' WHEN turnover_rate < 2 THEN 'calm' WHEN turnover_rate < 5 THEN 'active' WHEN turnover_rate <= 10 THEN 'hot' ELSE 'overheated' END AS heat,
  (t20 <= least_ * 1.1::DOUBLE)::INTEGER + (v20 < v60 * 0.5)::INTEGER + (close <= m20 * 1.02::DOUBLE)::INTEGER AS bottom_marks, (t5 > t20 * 2)::INTEGER + coalesce(volume > vb * 5, false)::INTEGER + (close > m5 * 1.08::DOUBLE)::INTEGER AS top_marks FROM y WHERE last_ = 1 AND r >= 60""")
def emotion_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.emotion_cycle(bars(spark, sf_dir).withColumn("turnover_rate", F.col("volume") / 40))


@query("""WITH x AS (SELECT event_id AS id, ['Bullish', 'bearish', 'NEUTRAL', NULL][event_id % 4 + 1] AS a, CASE WHEN event_id % 9 <> 0 THEN value END AS s, ['heavy', 'normal'][event_id % 2 + 1] AS v, event_id % 5 = 0 AS hot, event_id % 13 = 0 AS asked FROM events),
  g AS (SELECT *, CASE WHEN lower(a) = 'bullish' AND coalesce(s, 50) >= 70 THEN 'trending_up' WHEN lower(a) = 'bearish' AND coalesce(s, 50) <= 30 THEN 'trending_down' WHEN lower(a) = 'neutral' OR coalesce(s, 50) BETWEEN 35 AND 65 THEN 'sideways' WHEN v = 'heavy' AND coalesce(s, 50) > 30 AND coalesce(s, 50) < 70 THEN 'volatile' WHEN hot THEN 'sector_hot' END AS regime FROM x)
SELECT id, regime, CASE WHEN asked THEN 'a,b,c' WHEN regime = 'trending_up' THEN 'bull_trend,volume_breakout,ma_golden_cross' WHEN regime = 'trending_down' THEN 'shrink_pullback,bottom_volume' WHEN regime = 'sideways' THEN 'box_oscillation,shrink_pullback' WHEN regime = 'sector_hot' THEN 'dragon_head,emotion_cycle' ELSE 'bull_trend,shrink_pullback' END AS strategies FROM g""")
def strategy_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    regime = st.regime(of(("Bullish", "bearish", "NEUTRAL", None), 4), F.when(k % 9 != 0, F.col("value")), of(("heavy", "normal"), 2), k % 5 == 0)
    asked = F.when(k % 13 == 0, F.array(*map(F.lit, "abcd")))
    known = ("bull_trend", "volume_breakout", "ma_golden_cross", "shrink_pullback", "bottom_volume", "box_oscillation", "dragon_head", "emotion_cycle")
    return table(spark, sf_dir, "events").select(k.alias("id"), regime.alias("regime"), F.concat_ws(",", st.routed(regime, asked, known)).alias("strategies"))
