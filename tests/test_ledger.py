"""Literal cases of ledgers with splits, dividends and currencies, by both cost methods."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger, portfolio

TRADE = "account long, symbol string, currency string, date string, id long, side string, quantity double, price double, fee double, tax double"
ACTION = "account long, symbol string, currency string, date string, id long, kind string, ratio double, per_share double"
CASH = "account long, currency string, date string, direction string, amount double"


def snap(spark, cash, trades, actions, close, method, rates=(), currency="CNY", as_of="2026-02-01"):
    day = lambda df: df.withColumn("date", F.to_date("date"))
    c = day(spark.createDataFrame([(1, currency, d, w, a) for d, w, a in cash], CASH))
    t = day(spark.createDataFrame([(1, "600519", currency, d, i, s, q, p, f, x) for i, (d, s, q, p, f, x) in enumerate(trades)], TRADE))
    a = day(spark.createDataFrame([(1, "600519", currency, d, i, k, x, y) for i, (d, k, x, y) in enumerate(actions)], ACTION))
    b = day(spark.createDataFrame([("600519", "2026-01-31", close)], "symbol string, date string, close double"))
    r = spark.createDataFrame(list(rates), "from_currency string, to_currency string, rate_date string, rate double, is_stale boolean").withColumn("rate_date", F.to_date("rate_date"))
    accounts = spark.createDataFrame([(1, "CNY")], "account long, base string")
    rows = ledger.restated(t, a)
    held = ledger.positions(rows, method).first()
    return ledger.snapshot(accounts, c, t, a, b, r, F.lit(as_of).cast("date"), method).first(), held


@pytest.mark.parametrize(("method", "realized", "unrealized"), [("fifo", 2470, 245), ("average", 2220, 495)])
def test_cost_methods(spark, method, realized, unrealized):
    s, held = snap(spark, [("2026-01-01", "in", 10_000.0)], [("2026-01-02", "buy", 100.0, 10.0, 10.0, 0.0), ("2026-01-03", "buy", 100.0, 20.0, 10.0, 0.0), ("2026-01-04", "sell", 150.0, 30.0, 10.0, 5.0)], [], 25.0, method)
    assert (s.realized_pnl, s.unrealized_pnl, held.quantity) == pytest.approx((realized, unrealized, 50))
    assert s.equity == pytest.approx(10_000 - 1010 - 2010 + 4485 + 1250) and not s.fx_stale


@pytest.mark.parametrize("method", ["fifo", "average"])
def test_dividend_and_split(spark, method):
    s, held = snap(spark, [("2026-01-01", "in", 10_000.0)], [("2026-01-02", "buy", 100.0, 10.0, 0.0, 0.0)], [("2026-01-03", "dividend", None, 1.0), ("2026-01-04", "split", 2.0, None)], 6.0, method)
    assert (s.total_cash, s.market_value, s.equity, held.quantity, held.avg_cost) == pytest.approx((9100, 1200, 10_300, 200, 5))


@pytest.mark.parametrize("method", ["fifo", "average"])
def test_same_day_order(spark, method):
    s, _ = snap(spark, [("2026-01-01", "in", 2000.0)], [("2026-01-02", "buy", 100.0, 10.0, 0.0, 0.0)], [("2026-01-02", "dividend", None, 1.0)], 10.0, method)
    assert (s.total_cash, s.equity) == pytest.approx((1000, 2000))
    s, held = snap(spark, [("2026-01-01", "in", 2000.0)], [("2026-01-02", "buy", 100.0, 10.0, 0.0, 0.0), ("2026-01-03", "sell", 100.0, 6.0, 0.0, 0.0)], [("2026-01-03", "split", 2.0, None)], 6.0, method)
    assert (s.realized_pnl, s.total_cash, held.quantity, held.avg_cost) == pytest.approx((100, 1600, 100, 5))


@pytest.mark.parametrize("method", ["fifo", "average"])
def test_currencies_at_each_event(spark, method):
    rates = [("USD", "CNY", "2026-01-01", 7.0, False), ("USD", "CNY", "2026-01-10", 8.0, True)]
    trades = [("2026-01-02", "buy", 10.0, 10.0, 1.0, 0.0), ("2026-01-05", "sell", 5.0, 14.0, 1.0, 2.0)]
    s, _ = snap(spark, [("2026-01-01", "in", 1000.0)], trades, [], 20.0, method, rates, "USD")
    assert s.realized_pnl == pytest.approx((70 - 3 - 5 * 10.1) * 7) and (s.fee_total, s.tax_total) == pytest.approx((14, 14))
    assert s.total_cash == pytest.approx((1000 - 101 + 67) * 8) and s.market_value == pytest.approx(800) and s.fx_stale
    s, _ = snap(spark, [("2026-01-01", "in", 100.0)], [("2026-01-02", "buy", 1.0, 10.0, 0.0, 0.0)], [], 10.0, method, [("CNY", "HKD", "2025-12-01", 0.5, False)], "HKD")
    assert s.total_cash == pytest.approx(180) and not s.fx_stale
    s, _ = snap(spark, [("2026-01-01", "in", 100.0)], [("2026-01-02", "buy", 1.0, 10.0, 0.0, 0.0)], [], 10.0, method, [("CNY", "HKD", "2026-03-01", 0.5, False)], "HKD")
    assert s.total_cash == pytest.approx(90) and s.fx_stale


def test_oversell_by_split(spark):
    day = lambda df: df.withColumn("date", F.to_date("date"))
    t = day(spark.createDataFrame([(1, "a", "CNY", "2026-01-02", 1, "buy", 10.0, 1.0, 0.0, 0.0), (1, "a", "CNY", "2026-01-05", 2, "sell", 20.0, 1.0, 0.0, 0.0), (2, "a", "CNY", "2026-01-02", 3, "buy", 10.0, 1.0, 0.0, 0.0), (2, "a", "CNY", "2026-01-05", 4, "sell", 20.0, 1.0, 0.0, 0.0)], TRADE))
    a = day(spark.createDataFrame([(2, "a", "CNY", "2026-01-03", 1, "split", 2.0, None)], ACTION))
    assert [r.account for r in ledger.oversold(ledger.restated(t, a)).collect()] == [1]


def test_rates_of_many_months(spark):
    """The rate of a month that begins without one is the last one before; also far after the last."""
    r = spark.createDataFrame([("USD", "CNY", "1999-11-20", 7.0, False), ("USD", "CNY", "2000-03-05", 8.0, False), ("USD", "CNY", "2000-03-09", 9.0, False)], "from_currency string, to_currency string, rate_date string, rate double, is_stale boolean").withColumn("rate_date", F.to_date("rate_date"))
    days = {"1999-11-19": 1.0, "1999-11-20": 7.0, "1999-12-31": 7.0, "2000-03-01": 7.0, "2000-03-05": 8.0, "2000-03-09": 9.0, "2024-02-29": 9.0}
    d = spark.createDataFrame([(k, "USD", 1.0) for k in days], "on string, currency string, amount double").withColumn("on", F.to_date("on"))
    got = {str(x.on): (x.converted, x.stale) for x in portfolio.to_currency(d, r).collect()}
    assert got == {k: (v, k == "1999-11-19") for k, v in days.items()}
    r = r.union(r.sparkSession.createDataFrame([("CNY", "HKD", 0.5, False, "1999-01-01")], "f string, t string, rate double, s boolean, d string").selectExpr("f", "t", "rate", "s", "to_date(d)").select("f", "t", "rate", "s", F.col("to_date(d)")).toDF("from_currency", "to_currency", "rate", "is_stale", "rate_date").select(*r.columns))
    assert portfolio.to_currency(d.withColumn("currency", F.lit("HKD")), r).agg(F.min("converted"), F.max("converted")).first() == (2.0, 2.0)
