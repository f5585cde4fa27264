"""Queries on screening. The trade date is the last one of the bars."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, half_up_sql, r
from marketloom.operators import screening as s
from marketloom.plans.registry import query
from marketloom.sources.testdata import ANALYSES, BARS, INSTRUMENTS, MONTHLY_BARS, analyses, bars, instruments, table


def last_date(spark: SparkSession, sf_dir: str) -> datetime.date:
    return table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0]


RAW = """raw AS (SELECT s_suppkey * 2 + k AS ord, CASE WHEN s_suppkey % 7 = 0 THEN 'nan' ELSE '  sz' || CAST(s_suppkey AS VARCHAR) || ' ' END AS code,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '*st ' || s_name ELSE s_name END AS name FROM supplier, (VALUES (0), (1)) AS t(k))"""


@query(f"""WITH {RAW}, u AS (SELECT upper(trim(code)) AS code, coalesce(name, upper(trim(code))) AS name, ord FROM raw)
SELECT code, name, contains(upper(name), 'ST') AS is_st FROM u WHERE code NOT IN ('', 'NONE', 'NAN', 'NULL') QUALIFY row_number() OVER (PARTITION BY code ORDER BY ord) = 1""")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    raw = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (k * 2 + F.col("k")).alias("ord"), F.when(k % 7 == 0, "nan").otherwise(F.concat(F.lit("  sz"), k.cast("string"), F.lit(" "))).alias("code"),
        F.when(k % 5 == 0, None).when(k % 11 == 0, F.concat(F.lit("*st "), name)).otherwise(name).alias("name"))
    return s.universe(raw)


W = "PARTITION BY b.code ORDER BY b.date"
SNAPSHOT = f"""{BARS}, {INSTRUMENTS}, td AS (SELECT max(date) AS d FROM bars), f AS (
  SELECT b.*, i.name, i.list_date, i.is_st, td.d, count(*) OVER ({W}) AS n, {', '.join(f'avg(close) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS ma{n}' for n in (5, 10, 20, 60))},
    max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hb, coalesce(avg(amount) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS am,
    coalesce(avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS vm, coalesce((close / lag(close) OVER ({W}) - 1) * 100, 0.0) AS pct_chg
  FROM bars b JOIN instruments i ON b.code = i.code, td WHERE b.date BETWEEN td.d - 240 AND td.d
), g AS (
  SELECT *, coalesce(close / hb, 0.0) AS br, CASE WHEN vm <> 0 THEN volume / vm ELSE 0.0 END AS vr, coalesce(greatest(date_diff('day', list_date, d), 0), 9999) AS days_since_listed FROM f WHERE date = d AND n >= 20
), snapshot AS (
  SELECT code, name, close, ma5, ma10, ma20, ma60, pct_chg, is_st, CAST(days_since_listed AS INTEGER) AS days_since_listed, {half_up_sql('vr', 4)} AS volume_ratio, {half_up_sql('am', 2)} AS avg_amount, {half_up_sql('br', 4)} AS breakout_ratio,
    {half_up_sql('least(vr * 2, 100.0)', 4)} AS turnover_rate, (CASE WHEN close >= ma20 THEN 25.0 ELSE 0.0 END + CASE WHEN ma5 >= ma10 AND ma10 >= ma20 THEN 45.0 ELSE 0.0 END + CASE WHEN br >= 1 THEN 15.0 WHEN br >= 0.995 THEN 10.0 ELSE 0.0 END)::DOUBLE AS trend_score,
    {half_up_sql('least(least(am / 1e6, 80.0) + least(vr * 10, 20.0), 100.0)', 2)} AS liquidity_score,
    concat_ws(',', CASE WHEN is_st THEN 'st' END, CASE WHEN days_since_listed < 120 THEN 'new_listing' END, CASE WHEN vr < 1 THEN 'low_volume' END, CASE WHEN br < 0.98 THEN 'far_from_breakout' END) AS risk_flags FROM g
)"""
_AL = "(close >= ma20 AND ma5 >= ma10 AND ma10 >= ma20 AND ma20 > 0)"
SCREEN = f"""{SNAPSHOT}, screened_ AS (
  SELECT *, concat_ws(',', CASE WHEN is_st THEN 'st_filtered' END, CASE WHEN days_since_listed < 120 THEN 'listed_days_below_threshold' END, CASE WHEN avg_amount < 20000 THEN 'liquidity_below_threshold' END, CASE WHEN NOT {_AL} THEN 'trend_not_aligned' END, CASE WHEN volume_ratio < 1 THEN 'volume_below_threshold' END) AS reasons,
    concat_ws(',', CASE WHEN {_AL} THEN 'trend_aligned' END, CASE WHEN volume_ratio >= 1 THEN 'volume_expanding' END, CASE WHEN breakout_ratio >= 0.995 THEN 'near_breakout' END, CASE WHEN avg_amount >= 20000 THEN 'liquidity_ok' END) AS rule_hits,
    {half_up_sql(f"CASE WHEN {_AL} THEN 40 ELSE 0 END + CASE WHEN volume_ratio >= 1 THEN 30 ELSE 0 END + CASE WHEN breakout_ratio >= 0.995 THEN 20 ELSE 0 END + CASE WHEN avg_amount >= 20000 THEN 10 ELSE 0 END + greatest(breakout_ratio - 1, 0.0) * 1000 + least(volume_ratio, 3.0)", 2)} AS rule_score FROM snapshot
), screened AS (SELECT *, CASE WHEN reasons = '' THEN CAST(row_number() OVER (PARTITION BY reasons = '' ORDER BY rule_score DESC, code) AS INTEGER) END AS rank FROM screened_)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.factor_snapshot(bars(spark, sf_dir), instruments(spark, sf_dir), last_date(spark, sf_dir))


@query(f"WITH {SNAPSHOT} SELECT code, name, {R('ma5', 'ma10', 'ma20', 'ma60', 'pct_chg')}, close, is_st, days_since_listed, volume_ratio, avg_amount, breakout_ratio, turnover_rate, trend_score, liquidity_score, risk_flags FROM snapshot")
def factor_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("code", "name", *r("ma5", "ma10", "ma20", "ma60", "pct_chg"), "close", "is_st", "days_since_listed", "volume_ratio", "avg_amount", "breakout_ratio", "turnover_rate", "trend_score", "liquidity_score", F.concat_ws(",", "risk_flags").alias("risk_flags"))


#: The same at the last full month of monthly bars, at which most symbols have one, and some pass.
MONTHLY = SCREEN.replace(BARS, MONTHLY_BARS).replace("SELECT max(date) AS d FROM bars", "SELECT max(date) AS d FROM bars WHERE date < (SELECT max(date) FROM bars)").replace("td.d - 240", "td.d - 800")


@query(f"WITH {MONTHLY} SELECT code, rank, rule_score, rule_hits FROM screened WHERE rank IS NOT NULL")
def screen_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir, "month")
    full = F.add_months(F.lit(last_date(spark, sf_dir)).cast("date"), -1)
    month = spark.range(1).select(F.trunc(full, "month")).first()[0]
    day = s.factor_snapshot(df, instruments(spark, sf_dir), month, lookback=400)
    return s.screen(day).where("rank is not null").select("code", "rank", "rule_score", F.concat_ws(",", "rule_hits").alias("rule_hits"))


@query(f"WITH {SCREEN} SELECT code, reasons, rule_hits, rule_score FROM screened WHERE rank IS NULL")
def screen_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.screen(_snapshot(spark, sf_dir)).where("rank is null").select("code", F.concat_ws(",", "reasons").alias("reasons"), F.concat_ws(",", "rule_hits").alias("rule_hits"), "rule_score")


@query(f"""WITH {SCREEN}, {ANALYSES}, adv AS (SELECT code, arg_max(CASE advice WHEN '强烈买入' THEN 'strong_buy' WHEN '观望' THEN 'wait' ELSE advice END, id) AS advice FROM analyses GROUP BY code),
  nc AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, count(*) AS news_count FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount = 0.1 GROUP BY 1),
  fin AS (SELECT s.code, a.advice, rule_score + CASE a.advice WHEN 'strong_buy' THEN 8 WHEN 'buy' THEN 6 WHEN 'add' THEN 4 WHEN 'hold' THEN 2 WHEN 'wait' THEN 0 WHEN 'reduce' THEN -4 WHEN 'sell' THEN -8 ELSE 0 END + least(coalesce(news_count, 0), 3) AS final_score
    FROM screened s LEFT JOIN adv a ON s.code = a.code LEFT JOIN nc ON nc.code = s.code ORDER BY final_score DESC, s.code LIMIT 10)
SELECT code, advice, final_score, CAST(row_number() OVER (ORDER BY final_score DESC, code) AS INTEGER) AS final_rank FROM fin""")
def screen_final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot row competes here, so that small data has some."""
    advice = analyses(spark, sf_dir).groupBy("code").agg(F.max_by("advice", "id").alias("advice"))
    advice = advice.withColumn("advice", F.when(F.col("advice") == "强烈买入", "strong_buy").when(F.col("advice") == "观望", "wait").otherwise(F.col("advice")))
    news = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity = 50 and l_discount = 0.1D").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"))
    return s.final_rank(s.screen(_snapshot(spark, sf_dir)).select("code", "rule_score"), advice, news, 10).select("code", "advice", "final_score", "final_rank")


@query(f"""WITH {BARS}, {INSTRUMENTS}, h AS (SELECT count(*) AS expected, count(b.code) AS available FROM instruments i LEFT JOIN bars b ON b.code = i.code AND b.date = (SELECT max(date) FROM bars))
SELECT expected, available, expected - available AS missing, {half_up_sql('available / expected', 4)} AS available_rate, (expected - available) / expected > 0.02 AS blocked FROM h""")
def sync_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sync_health(instruments(spark, sf_dir), bars(spark, sf_dir), last_date(spark, sf_dir))
