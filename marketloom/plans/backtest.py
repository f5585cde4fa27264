"""Queries on backtests of the order-derived recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.operators import backtest as b
from marketloom.operators.asof import asof
from marketloom.plans.registry import query
from marketloom.sources.testdata import ANALYSES, BARS, analyses, bars

W = "PARTITION BY code ORDER BY date"
START = f"""{BARS}, {ANALYSES}, seq AS (SELECT *, row_number() OVER ({W}) AS k FROM bars), at_ AS (
  SELECT a.id, a.code, a.advice, s.date AS start_date, s.close AS start, s.k FROM analyses a ASOF JOIN seq s ON a.code = s.code AND a.date >= s.date
)"""
EVAL = f"""{START}, w AS (
  SELECT a.id, count(*) AS n, arg_max(f.close, f.k) AS end_, max(f.high) AS max_high, min(f.low) AS min_low,
    min(f.k - a.k) FILTER (WHERE f.low <= a.start * (1 - 0.05) OR f.high >= a.start * (1 + 0.10)) AS hk
  FROM at_ a JOIN seq f ON f.code = a.code AND f.k > a.k AND f.k <= a.k + 10 GROUP BY a.id
), e AS (
  SELECT a.*, coalesce(w.n, 0) AS n, CASE WHEN w.n = 10 THEN end_ END AS "end", CASE WHEN w.n = 10 THEN max_high END AS max_high, CASE WHEN w.n = 10 THEN min_low END AS min_low, w.n = 10 AS done, a.start * (1 - 0.05) AS sp, a.start * (1 + 0.10) AS tp,
    CASE advice WHEN '强烈买入' THEN 'up' WHEN 'buy' THEN 'up' WHEN 'hold' THEN 'not_down' WHEN 'sell' THEN 'down' ELSE 'flat' END AS direction, CASE WHEN advice IN ('sell', '观望') THEN 'cash' ELSE 'long' END AS position, hk
  FROM at_ a LEFT JOIN w ON a.id = w.id
), h AS (
  SELECT e.*, CASE WHEN coalesce(done, false) THEN 'completed' ELSE 'insufficient_data' END AS eval_status, ("end" - start) * 100 / start AS stock_return_pct,
    CASE WHEN done AND position = 'long' THEN hk END AS first_hit_days, f.low <= sp AS s, f.high >= tp AS t
  FROM e LEFT JOIN seq f ON done AND position = 'long' AND f.code = e.code AND f.k = e.k + hk
), results AS (
  SELECT id, code, advice, start_date, start, "end", eval_status, direction, position, stock_return_pct, max_high, min_low, first_hit_days,
    CASE WHEN stock_return_pct IS NULL THEN NULL WHEN direction = 'up' THEN CASE WHEN stock_return_pct >= 2 THEN 'win' WHEN stock_return_pct <= -2 THEN 'loss' ELSE 'neutral' END
      WHEN direction = 'down' THEN CASE WHEN stock_return_pct <= -2 THEN 'win' WHEN stock_return_pct >= 2 THEN 'loss' ELSE 'neutral' END
      WHEN direction = 'not_down' THEN CASE WHEN stock_return_pct >= 0 THEN 'win' WHEN stock_return_pct <= -2 THEN 'loss' ELSE 'neutral' END
      ELSE CASE WHEN abs(stock_return_pct) <= 2 THEN 'win' ELSE 'loss' END END AS outcome,
    CASE WHEN done AND position = 'long' THEN coalesce(s, false) END AS hit_stop_loss, CASE WHEN done AND position = 'long' THEN coalesce(t, false) END AS hit_take_profit,
    CASE WHEN eval_status <> 'completed' THEN NULL WHEN position <> 'long' THEN 'not_applicable' WHEN s AND t THEN 'ambiguous' WHEN s THEN 'stop_loss' WHEN t THEN 'take_profit' ELSE 'neither' END AS first_hit,
    CASE WHEN done THEN CASE WHEN position = 'long' THEN ((CASE WHEN s THEN sp WHEN t THEN tp ELSE "end" END) - start) * 100 / start ELSE 0.0 END END AS simulated_return_pct
  FROM h
)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.evaluate(analyses(spark, sf_dir), bars(spark, sf_dir))


@query(f"WITH {START} SELECT id, code, start_date, start FROM at_")
def asof_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = asof(analyses(spark, sf_dir), bars(spark, sf_dir).select("code", "date", "close"), ["code"], "date", "date", "b").where("b is not null")
    return df.select("id", "code", F.col("b.date").alias("start_date"), F.col("b.close").alias("start"))


@query(f"WITH {START} SELECT a.id, CAST(f.k - a.k AS INTEGER) AS k, f.date, f.close FROM at_ a JOIN seq f ON f.code = a.code AND f.k > a.k AND f.k <= a.k + 3")
def forward_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = asof(analyses(spark, sf_dir), b.with_forward(bars(spark, sf_dir), 3), ["code"], "date", "date", "b")
    return df.select("id", F.posexplode("b.ahead").alias("k", "x")).select("id", (F.col("k") + 1).alias("k"), "x.date", "x.close")


@query(f"""WITH {EVAL} SELECT id, code, start_date, eval_status, direction, position, outcome, hit_stop_loss, hit_take_profit, first_hit, CAST(first_hit_days AS INTEGER) AS first_hit_days, {R('stock_return_pct', 'simulated_return_pct')}, max_high, min_low FROM results""")
def backtest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("id", "code", "start_date", "eval_status", "direction", "position", "outcome", "hit_stop_loss", "hit_take_profit", "first_hit", "first_hit_days", *r("stock_return_pct", "simulated_return_pct"), "max_high", "min_low")


_P = "100.0::DOUBLE * count(*) FILTER (WHERE {0}) / nullif(count(*) FILTER (WHERE {1}), 0)"
_T = "eval_status = 'completed' AND position = 'long' AND hit_stop_loss IS NOT NULL"
SUMMARY = f"""{EVAL}, m AS (SELECT CASE WHEN grouping(code) = 1 THEN '__overall__' ELSE code END AS code, count(*) AS total, count(*) FILTER (WHERE eval_status = 'completed') AS completed, count(*) FILTER (WHERE eval_status = 'insufficient_data') AS insufficient,
  count(*) FILTER (WHERE eval_status = 'completed' AND position = 'long') AS long, count(*) FILTER (WHERE eval_status = 'completed' AND position = 'cash') AS cash,
  count(*) FILTER (WHERE outcome = 'win') AS win, count(*) FILTER (WHERE outcome = 'loss') AS loss, count(*) FILTER (WHERE outcome = 'neutral') AS neutral,
  {_P.format("outcome = 'win'", "outcome IN ('win', 'loss')")} AS direction_accuracy_pct, {_P.format("outcome = 'win'", "outcome IN ('win', 'loss')")} AS win_rate_pct, {_P.format("outcome = 'neutral'", "eval_status = 'completed'")} AS neutral_rate_pct,
  avg(stock_return_pct) AS avg_stock_return_pct, avg(simulated_return_pct) AS avg_simulated_return_pct, {_P.format(_T + ' AND hit_stop_loss', _T)} AS stop_loss_rate, {_P.format(_T + ' AND hit_take_profit', _T)} AS take_profit_rate,
  {_P.format(_T + " AND first_hit = 'ambiguous'", _T)} AS ambiguous_rate, avg(first_hit_days) AS avg_days_to_first_hit FROM results GROUP BY GROUPING SETS ((code), ()))"""
_METRICS = ("direction_accuracy_pct", "win_rate_pct", "neutral_rate_pct", "avg_stock_return_pct", "avg_simulated_return_pct", "stop_loss_rate", "take_profit_rate", "ambiguous_rate", "avg_days_to_first_hit")
_COUNTS = ("total", "completed", "insufficient", "long", "cash", "win", "loss", "neutral")


@query(f"WITH {SUMMARY} SELECT code, {', '.join(_COUNTS)}, {R(*_METRICS)} FROM m")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.summary(_results(spark, sf_dir)).select("code", *_COUNTS, *r(*_METRICS))


@query(f"WITH {EVAL}, g AS (SELECT advice, count(*) AS total, count(*) FILTER (WHERE outcome = 'win') AS win, count(*) FILTER (WHERE outcome = 'loss') AS loss FROM results WHERE eval_status = 'completed' GROUP BY advice), p AS (SELECT *, 100.0::DOUBLE * win / (win + loss) AS win_rate_pct FROM g) SELECT advice, total, win, loss, {R('win_rate_pct')} FROM p")
def advice_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.advice_breakdown(_results(spark, sf_dir)).select("advice", "total", "win", "loss", *r("win_rate_pct"))


@query(f"WITH {EVAL} SELECT 'status' AS kind, eval_status AS value, count(*) AS n FROM results GROUP BY 2 UNION ALL SELECT 'first_hit', coalesce(first_hit, '(none)'), count(*) FROM results GROUP BY 2")
def backtest_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.diagnostics(_results(spark, sf_dir))


@query(f"WITH {ANALYSES} SELECT * FROM analyses WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def backtest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return b.candidates(analyses(spark, sf_dir), done)


STATS = f"""{EVAL}, st AS (SELECT advice AS strategy, count(*) FILTER (WHERE outcome IN ('win', 'loss')) AS samples, count(*) FILTER (WHERE outcome = 'win') / count(*) FILTER (WHERE outcome IN ('win', 'loss')) AS win_rate FROM results GROUP BY advice),
  raw AS (SELECT *, CASE WHEN samples >= 30 THEN 0.5 + win_rate ELSE 1.0 END AS raw FROM st), wts AS (SELECT *, raw / avg(raw) OVER () AS weight FROM raw)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _results(spark, sf_dir).groupBy(F.col("advice").alias("strategy")).agg(F.count_if(F.col("outcome").isin("win", "loss")).alias("samples"), F.count_if(F.col("outcome") == "win").alias("wins"))
    return g.select("strategy", "samples", F.try_divide("wins", "samples").alias("win_rate"))


@query(f"WITH {STATS} SELECT strategy, samples, {R('weight')} FROM wts")
def strategy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.strategy_weights(_stats(spark, sf_dir)).select("strategy", "samples", *r("weight"))


@query(f"WITH {STATS}, c AS (SELECT strategy, least(1.5, greatest(0.5, win_rate / 0.6)) AS factor FROM st) SELECT strategy, {R('factor')} FROM c")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.calibration(_stats(spark, sf_dir).withColumnRenamed("win_rate", "accuracy")).select("strategy", *r("factor"))


@query(f"""WITH {STATS}, op AS (SELECT code, advice AS strategy, 1 + id % 5 AS score, (id % 10) / 10.0::DOUBLE AS confidence FROM analyses), g AS (
  SELECT code, count(*) AS n, sum(score * weight) / sum(weight) AS score, sum(confidence * weight) / sum(weight) AS confidence FROM op JOIN wts USING (strategy) GROUP BY code
) SELECT code, n, {R('score', 'confidence')}, CASE WHEN score >= 4.5 THEN 'strong_buy' WHEN score >= 3.5 THEN 'buy' WHEN score >= 2.5 THEN 'hold' WHEN score >= 1.5 THEN 'sell' ELSE 'strong_sell' END AS signal FROM g""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    opinions = analyses(spark, sf_dir).select("code", F.col("advice").alias("strategy"), (1 + F.col("id") % 5).alias("score"), (F.col("id") % 10 / F.lit(10.0)).alias("confidence"))
    return b.consensus(opinions, b.strategy_weights(_stats(spark, sf_dir))).select("code", "n", *r("score", "confidence"), "signal")
