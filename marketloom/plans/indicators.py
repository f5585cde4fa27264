"""Queries on bars and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.plans.registry import query
from marketloom.functions.rounding import R, r
from marketloom.sources.testdata import BARS, bars


W = "PARTITION BY code ORDER BY date"


def sma(c: str, n: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {f} = {n} THEN avg({c}) {f} END"


MA = f"""{BARS}, ma_ AS (
  SELECT *, {sma('close', 5)} AS ma5, {sma('close', 10)} AS ma10, {sma('close', 20)} AS ma20, {sma('close', 60)} AS ma60_, count(*) OVER (PARTITION BY code) AS n_bars, row_number() OVER ({W}) AS i FROM bars
), ma AS (SELECT *, CASE WHEN n_bars >= 60 THEN ma60_ ELSE ma20 END AS ma60 FROM ma_)"""

TREND = f"""{MA}, spread AS (
  SELECT *, (ma5 - ma20) * 100 / ma20 AS up, (ma20 - ma5) * 100 / ma5 AS down FROM ma
), wider AS (
  SELECT *, up > lag(up, 4) OVER ({W}) AND up > 5 AS wide_up, down > lag(down, 4) OVER ({W}) AND down > 5 AS wide_down FROM spread
), trend AS (
  SELECT *, CASE WHEN ma20 IS NULL THEN NULL
    WHEN ma5 > ma10 AND ma10 > ma20 THEN CASE WHEN wide_up THEN 'STRONG_BULL' ELSE 'BULL' END
    WHEN ma5 > ma10 THEN 'WEAK_BULL'
    WHEN ma5 < ma10 AND ma10 < ma20 THEN CASE WHEN wide_down THEN 'STRONG_BEAR' ELSE 'BEAR' END
    WHEN ma5 < ma10 THEN 'WEAK_BEAR' ELSE 'CONSOLIDATION' END AS trend_status
  FROM wider
)"""


def ema_sql(source: str, column: str, span: int, table: str, to: str) -> str:
    b = f"(1.0::DOUBLE - {2.0 / (span + 1)!r}::DOUBLE)"
    return f"""{to} AS (SELECT *, sum(CASE WHEN i = 1 THEN {column} ELSE {2.0 / (span + 1)!r}::DOUBLE * {column} * pow({b}, -(i - 1)) END) OVER ({W} ROWS UNBOUNDED PRECEDING) * pow({b}, i - 1) AS {to}_v FROM {source})"""


MACD = ", ".join([ema_sql("{0}", "close", 12, "", "fast"), ema_sql("fast", "close", 26, "", "slow"), "dif_ AS (SELECT *, fast_v - slow_v AS dif FROM slow)", ema_sql("dif_", "dif", 9, "", "dea"), "macd AS (SELECT *, dea_v AS dea, 2 * (dif - dea_v) AS bar FROM dea)"])
MACD_STATUS = f"""gaps AS (
  SELECT *, lag(dif - dea) OVER ({W}) AS gap_before, lag(dif) OVER ({W}) AS dif_before FROM macd
), macd_s AS (
  SELECT *, CASE WHEN i < 26 THEN 'BULLISH' WHEN gap_before <= 0 AND dif - dea > 0 AND dif > 0 THEN 'GOLDEN_CROSS_ZERO' WHEN dif_before <= 0 AND dif > 0 THEN 'CROSSING_UP'
    WHEN gap_before <= 0 AND dif - dea > 0 THEN 'GOLDEN_CROSS' WHEN gap_before >= 0 AND dif - dea < 0 THEN 'DEATH_CROSS' WHEN dif_before >= 0 AND dif < 0 THEN 'CROSSING_DOWN'
    WHEN dif > 0 AND dea > 0 THEN 'BULLISH' WHEN dif < 0 AND dea < 0 THEN 'BEARISH' ELSE 'BULLISH' END AS macd_status FROM gaps
)"""


def rsi_sql(source: str) -> str:
    cols = ", ".join(
        f"CASE WHEN i < {n} OR (g{n} < 1e-12 AND l{n} < 1e-12) THEN 50.0::DOUBLE WHEN l{n} < 1e-12 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi{n}" for n in (6, 12, 24)
    )
    means = ", ".join(f"avg(g) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS g{n}, avg(l) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l{n}" for n in (6, 12, 24))
    return f"""moves AS (
  SELECT *, greatest(coalesce(close - lag(close) OVER ({W}), 0.0::DOUBLE), 0.0::DOUBLE) AS g, greatest(-coalesce(close - lag(close) OVER ({W}), 0.0::DOUBLE), 0.0::DOUBLE) AS l FROM {source}
), gl AS (SELECT *, {means} FROM moves), rsi_ AS (SELECT *, {cols} FROM gl), rsi AS (
  SELECT *, CASE WHEN i < 24 THEN 'NEUTRAL' WHEN rsi12 > 70 THEN 'OVERBOUGHT' WHEN rsi12 > 60 THEN 'STRONG_BUY' WHEN rsi12 >= 40 THEN 'NEUTRAL' WHEN rsi12 >= 30 THEN 'WEAK' ELSE 'OVERSOLD' END AS rsi_status FROM rsi_
)"""


def volume_sql(source: str) -> str:
    f = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    return f"""vol_ AS (
  SELECT *, CASE WHEN i >= 5 AND avg(volume) {f} > 0 THEN volume / avg(volume) {f} ELSE 0.0::DOUBLE END AS volume_ratio_5d, close > lag(close) OVER ({W}) AS rose FROM {source}
), vol AS (
  SELECT *, CASE WHEN i < 5 THEN 'NORMAL' WHEN volume_ratio_5d >= 1.5 THEN CASE WHEN rose THEN 'HEAVY_UP' ELSE 'HEAVY_DOWN' END
    WHEN volume_ratio_5d <= 0.7 THEN CASE WHEN rose THEN 'SHRINK_UP' ELSE 'SHRINK_DOWN' END ELSE 'NORMAL' END AS volume_status FROM vol_
)"""


def support_sql(source: str) -> str:
    near = lambda m: f"coalesce(abs(close - {m}) / {m} <= 0.02 AND close >= {m}, false)"
    f = f"OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"""sup AS (
  SELECT *, {near('ma5')} AS support_ma5, {near('ma10')} AS support_ma10, coalesce(close >= ma20, false) AS support_ma20,
    CASE WHEN count(*) {f} = 20 AND max(high) {f} > close THEN max(high) {f} END AS resistance FROM {source}
)"""


NUMBERED = f"{BARS}, numbered AS (SELECT *, row_number() OVER ({W}) AS i FROM bars)"


@query(f"WITH {BARS} SELECT code, date, open, high, low, close, {R('amount')}, volume FROM bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("code", "date", "open", "high", "low", "close", "volume", *r("amount"))


@query(f"WITH {MA} SELECT code, date, {R('ma5', 'ma10', 'ma20', 'ma60')} FROM ma")
def ma_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.moving_averages(bars(spark, sf_dir)).select("code", "date", *r("ma5", "ma10", "ma20", "ma60"))


@query(f"""WITH {BARS}, x AS (SELECT code, date, {', '.join(f'avg(close) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS ma{n}' for n in (5, 10, 20))},
  coalesce(volume / avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS volume_ratio FROM bars) SELECT code, date, {R('ma5', 'ma10', 'ma20', 'volume_ratio')} FROM x""")
def ma_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.lenient_averages(bars(spark, sf_dir)).select("code", "date", *r("ma5", "ma10", "ma20", "volume_ratio"))


@query(f"WITH {BARS}, x AS (SELECT code, date, coalesce((close / lag(close) OVER ({W}) - 1) * 100, 0.0::DOUBLE) AS pct_chg FROM bars) SELECT code, date, {R('pct_chg')} FROM x")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.pct_change(bars(spark, sf_dir)).select("code", "date", *r("pct_chg"))


@query(f"WITH {NUMBERED}, {MACD.replace('{0}', 'numbered')}, {MACD_STATUS} SELECT code, date, {R('dif', 'dea', 'bar')}, macd_status FROM macd_s")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.macd_status(ind.macd(bars(spark, sf_dir))).select("code", "date", "macd_status", *r("dif", "dea", "bar"))


@query(f"WITH {NUMBERED}, {rsi_sql('numbered')} SELECT code, date, {R('rsi6', 'rsi12', 'rsi24')}, rsi_status FROM rsi")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rsi_status(ind.rsi(bars(spark, sf_dir))).select("code", "date", "rsi_status", *r("rsi6", "rsi12", "rsi24"))


@query(f"WITH {TREND} SELECT code, date, trend_status FROM trend WHERE trend_status IS NOT NULL")
def trend_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.trend_status(ind.moving_averages(bars(spark, sf_dir))).where("trend_status is not null").select("code", "date", "trend_status")


@query(f"WITH {NUMBERED}, {volume_sql('numbered')} SELECT code, date, {R('volume_ratio_5d')}, volume_status FROM vol")
def volume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.volume_status(bars(spark, sf_dir)).select("code", "date", "volume_status", *r("volume_ratio_5d"))


@query(f"WITH {MA}, {support_sql('ma')} SELECT code, date, support_ma5, support_ma10, support_ma20, resistance FROM sup")
def support_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.support_resistance(ind.moving_averages(bars(spark, sf_dir))).select("code", "date", "support_ma5", "support_ma10", "support_ma20", "resistance")


def case(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


SIGNAL = f"""WITH {TREND}, {MACD.replace('{0}', 'trend')}, {MACD_STATUS}, {rsi_sql('macd_s')}, {volume_sql('rsi')}, {support_sql('vol')}, biased AS (
  SELECT *, (close - ma5) * 100 / ma5 AS bias_ma5, CASE WHEN trend_status = 'STRONG_BULL' THEN 7.5 ELSE 5.0 END AS bound FROM sup WHERE ma20 IS NOT NULL
), scored AS (
  SELECT *, {case('trend_status', ind.TREND_POINTS)} + {case('volume_status', ind.VOLUME_POINTS)} + {case('macd_status', ind.MACD_POINTS)} + {case('rsi_status', ind.RSI_POINTS)}
    + CASE WHEN support_ma5 THEN 5 ELSE 0 END + CASE WHEN support_ma10 THEN 5 ELSE 0 END
    + CASE WHEN bias_ma5 < 0 THEN CASE WHEN bias_ma5 > -3 THEN 20 WHEN bias_ma5 > -5 THEN 16 ELSE 8 END WHEN bias_ma5 < 2 THEN 18 WHEN bias_ma5 < 5 THEN 14
           WHEN bias_ma5 > bound THEN 4 WHEN bias_ma5 > 5 AND trend_status = 'STRONG_BULL' THEN 10 ELSE 4 END AS signal_score
  FROM biased
) SELECT code, date, trend_status, volume_status, macd_status, rsi_status, signal_score, {R('bias_ma5')},
  CASE WHEN signal_score >= 75 AND trend_status IN ('STRONG_BULL', 'BULL') THEN 'STRONG_BUY' WHEN signal_score >= 60 AND trend_status IN ('STRONG_BULL', 'BULL', 'WEAK_BULL') THEN 'BUY'
       WHEN signal_score >= 45 THEN 'HOLD' WHEN signal_score >= 30 THEN 'WAIT' WHEN trend_status IN ('BEAR', 'STRONG_BEAR') THEN 'STRONG_SELL' ELSE 'SELL' END AS buy_signal,
  concat_ws(',', CASE WHEN trend_status IN ('STRONG_BULL', 'BULL') THEN 'trend' END, CASE WHEN bias_ma5 > -5 AND bias_ma5 < 5 THEN 'bias' END, CASE WHEN volume_status = 'SHRINK_DOWN' THEN 'volume' END,
    CASE WHEN support_ma5 THEN 'support_ma5' END, CASE WHEN support_ma10 THEN 'support_ma10' END, CASE WHEN macd_status LIKE 'GOLDEN%' THEN 'macd' END, CASE WHEN rsi_status IN ('OVERSOLD', 'STRONG_BUY') THEN 'rsi' END) AS reasons
FROM scored"""


@query(SIGNAL)
def trend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.trend_signal(bars(spark, sf_dir))
    return df.select("code", "date", "trend_status", "volume_status", "macd_status", "rsi_status", "signal_score", *r("bias_ma5"), "buy_signal", F.concat_ws(",", "reasons").alias("reasons"))


@query(f"""{SIGNAL.replace('FROM scored', 'FROM scored QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1')} ORDER BY signal_score DESC, code LIMIT 20""")
def trend_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best signals of the latest bars."""
    df = ind.latest(ind.trend_signal(bars(spark, sf_dir))).orderBy(F.desc("signal_score"), "code").limit(20)
    return df.select("code", "date", "trend_status", "volume_status", "macd_status", "rsi_status", "signal_score", *r("bias_ma5"), "buy_signal", F.concat_ws(",", "reasons").alias("reasons"))


PERIODS = (5, 10, 20, 30, 60, 120, 250)


@query(f"""WITH {BARS}, x AS (SELECT code, date, close, {', '.join(f'{sma("close", n)} AS ma{n}' for n in PERIODS)} FROM bars), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, {R('close', *(f'ma{n}' for n in PERIODS))}, {' + '.join(f'CASE WHEN close > ma{n} THEN 1 ELSE 0 END' for n in PERIODS)} AS above FROM y""")
def calculate_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.calculate_ma(bars(spark, sf_dir)).select("code", *r("close", *(f"ma{n}" for n in PERIODS)), "above")


@query(f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM bars QUALIFY n <= 30), u AS (
  SELECT *, coalesce(close > lag(close) OVER ({W}), false) AS up, CASE WHEN count(*) OVER (PARTITION BY code) >= 20 THEN avg(volume) FILTER (WHERE n <= 20) OVER (PARTITION BY code) ELSE avg(volume) FILTER (WHERE n <= 10) OVER (PARTITION BY code) END AS m20 FROM t
), g AS (
  SELECT code, count(*) AS period_days, max(volume) FILTER (WHERE n = 1) AS latest_volume, avg(volume) FILTER (WHERE n <= 5) AS avg_volume_5d, max(m20) AS avg_volume_20d,
    coalesce(avg(volume) FILTER (WHERE up), 0.0::DOUBLE) AS avg_up, coalesce(avg(volume) FILTER (WHERE NOT up), 0.0::DOUBLE) AS avg_down, avg(volume) FILTER (WHERE n BETWEEN 6 AND 10) AS prior,
    CAST(count(*) FILTER (WHERE volume > m20 * 2) AS INTEGER) AS high_volume_days, corr(volume, close) AS volume_price_corr FROM u GROUP BY code
), h AS (SELECT *, latest_volume / avg_volume_5d AS ratio_5d, CASE WHEN period_days >= 10 THEN coalesce((avg_volume_5d - prior) * 100 / prior, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS trend_pct FROM g WHERE period_days >= 5)
SELECT code, period_days, high_volume_days, {R('latest_volume', 'avg_volume_5d', 'avg_volume_20d', 'avg_up', 'avg_down', 'volume_price_corr', 'ratio_5d', 'trend_pct')},
  CASE WHEN period_days < 10 THEN '数据不足' WHEN trend_pct > 20 THEN '放量' WHEN trend_pct < -20 THEN '缩量' ELSE '量能平稳' END AS volume_trend,
  CASE WHEN avg_up > avg_down * 1.3 THEN 'healthy' WHEN avg_down > avg_up * 1.3 THEN 'divergent' WHEN ratio_5d > 1.5 THEN 'expanding' WHEN ratio_5d < 0.6 THEN 'shrinking' ELSE 'neutral' END AS pattern FROM h""")
def volume_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.volume_analysis(bars(spark, sf_dir))
    return df.select("code", "period_days", "high_volume_days", *r("latest_volume", "avg_volume_5d", "avg_volume_20d", "avg_up", "avg_down", "volume_price_corr", "ratio_5d", "trend_pct"), "volume_trend", "pattern")


def _l(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({W})"


LAST60 = f"""{BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM bars QUALIFY n <= 60)"""
DOUBLE_BOTTOM = """k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY low, n DESC) AS k FROM t), pair AS (
  SELECT code, max(n) AS n1, min(n) AS n2, arg_max(low, n) AS low1, arg_min(low, n) AS low2 FROM k WHERE k <= 2 GROUP BY code
), bottoms AS (
  SELECT p.code, CAST(1 - n2 AS INTEGER) AS "offset", low1, low2 FROM pair p JOIN k ON k.code = p.code AND k.n BETWEEN n2 AND n1
  WHERE n1 - n2 >= 5 AND abs(low1 - low2) / greatest(low1, low2) < 0.03 GROUP BY p.code, n1, n2, low1, low2 HAVING max(high) > low1 * 1.03
)"""
_SHAPES = {
    "doji": "n <= 3 AND body < m * 0.1 AND us + ls > body * 3",
    "hammer": "n <= 3 AND ls > body * 2 AND us < body * 0.5 AND (pc IS NULL OR close >= pc)",
    "hanging man": "n <= 3 AND ls > body * 2 AND us < body * 0.5 AND close < pc",
    "shooting star": "n <= 3 AND us > body * 2 AND ls < body * 0.5 AND bear",
    "inverted hammer": "n <= 3 AND us > body * 2 AND ls < body * 0.5 AND NOT bear",
    "big up": "n <= 3 AND body > m * 2.5 AND bull",
    "big down": "n <= 3 AND body > m * 2.5 AND NOT bull",
    "morning star": "star AND bear2 AND bull AND close > mid",
    "evening star": "star AND bull2 AND bear AND close < mid",
    "bullish engulfing": "bull_e",
    "bearish engulfing": "n = 1 AND size >= 3 AND bear AND bull1 AND open > pc AND close < po AND NOT coalesce(bull_e, false)",
    "breakout": "n = 1 AND size >= 21 AND close > hi20 AND volume > v5 * 1.5",
    "box": "n = 1 AND size >= 10 AND (hi10 - lo10) * 100 / lo10 < 8",
}
_OFFSET = {"morning star": "-2", "evening star": "-2", "bullish engulfing": "-1", "bearish engulfing": "-1", "breakout": "0", "box": "0"}


@query(f"""WITH {LAST60}, {DOUBLE_BOTTOM}, f AS (
  SELECT *, count(*) OVER (PARTITION BY code) AS size, abs(close - open) AS body, high - greatest(open, close) AS us, least(open, close) - low AS ls, close > open AS bull, close < open AS bear FROM t
), m AS (SELECT *, avg(body) OVER (PARTITION BY code) AS m FROM f), x AS (
  SELECT *, {_l('close')} AS pc, {_l('open')} AS po, {_l('bear')} AS bear1, {_l('bull')} AS bull1, {_l('bear', 2)} AS bear2, {_l('bull', 2)} AS bull2, ({_l('open', 2)} + {_l('close', 2)}) / 2 AS mid,
    {_l('body', 2)} > m * 1.5 AND {_l('body')} < m * 0.4 AND body > m * 1.5 AND n = 1 AND size >= 3 AS star,
    max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi20, avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v5,
    max(high) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hi10, min(low) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lo10 FROM m
), y AS (SELECT *, n = 1 AND size >= 3 AND bull AND bear1 AND open < pc AND close > po AS bull_e FROM x), z AS (
  {' UNION ALL '.join(f"SELECT code, date, '{k}' AS pattern, CAST({_OFFSET.get(k, '1 - n')} AS INTEGER) AS " + '"offset"' + f" FROM y WHERE {v}" for k, v in _SHAPES.items())}
), u AS (SELECT code, pattern, "offset" FROM z QUALIFY row_number() OVER (PARTITION BY code, pattern ORDER BY date DESC) = 1)
SELECT * FROM u UNION ALL SELECT code, 'double bottom', "offset" FROM bottoms""")
def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.candle_patterns(bars(spark, sf_dir))


@query(f"""WITH {MA}, v AS (
  SELECT *, volume / avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ratio, (close - ma5) * 100 / ma5 AS bias, max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi20,
    CASE WHEN ma5 > ma10 THEN 1 WHEN ma5 <= ma10 THEN 0 END AS above, {_l('ma20', 5)} AS ma20_before, CASE WHEN high <> low THEN (close - low) / (high - low) END AS top FROM ma
), x AS (SELECT *, CASE WHEN above = 1 AND {_l('above')} = 0 THEN 1 ELSE 0 END AS crossing FROM v), y AS (SELECT *, max(crossing) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS crossed FROM x)
SELECT code, date, 'ma_golden_cross' AS strategy FROM y WHERE crossed AND ratio > 1.2 AND bias < 5
UNION ALL SELECT code, date, 'shrink_pullback' FROM y WHERE ma5 > ma10 AND ma10 > ma20 AND (abs(close - ma5) / ma5 <= 0.01 OR abs(close - ma10) / ma10 <= 0.02) AND ratio < 0.7
UNION ALL SELECT code, date, 'volume_breakout' FROM y WHERE ratio > 2 AND close > hi20 AND top >= 0.7 AND bias < 5
UNION ALL SELECT code, date, 'bottom_volume' FROM y WHERE close <= hi20 * 0.85 AND ratio > 3 AND close > open
UNION ALL SELECT code, date, 'bull_trend' FROM y WHERE ma5 >= ma10 AND ma10 >= ma20 AND ma20 > ma20_before""")
def rule_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rule_strategies(bars(spark, sf_dir))
