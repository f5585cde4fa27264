"""Queries on ledgers with splits, dividends and currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.operators import ledger
from marketloom.plans.portfolio import CUR, RATES_SQL, RAW, currency, rates, raw_trades
from marketloom.plans.registry import query
from marketloom.sources.testdata import BARS, bars, table
from marketloom.sources.versions import Versions
from marketloom.sources.writes import kept, scratch

AS_OF = "2000-06-30"


def _id():
    return F.concat_ws("-", *(F.lpad(F.col(f"id.{c}").cast("string"), 9, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey")), F.format_string("%014.2f", F.col("id.l_extendedprice")))


ID = "concat_ws('-', lpad(CAST(k1 AS VARCHAR), 9, '0'), lpad(CAST(k2 AS VARCHAR), 9, '0'), lpad(CAST(k3 AS VARCHAR), 9, '0'), printf('%014.2f', k5))"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of all accounts and splits and dividends of all symbols, restated; positions that would be oversold are left out."""
    t = raw_trades(spark, sf_dir).withColumns({"id": _id(), "currency": currency()})
    keys = t.select(*ledger.POSITION).distinct()
    acts = spark.createDataFrame([("1996-05-06", "a1", "split", 2.0, None), ("1997-03-03", "a2", "dividend", None, 0.5), ("1998-11-11", "a3", "split", 0.5, None), ("1999-02-02", "a4", "dividend", None, 0.25), ("2003-01-01", "a5", "split", 10.0, None)], "date string, id string, kind string, ratio double, per_share double")
    # five actions a symbol, sent to every position: their product is the table of actions
    acts = keys.join(F.broadcast(acts.withColumn("date", F.to_date("date"))), F.lit(True))
    return ledger.sound(ledger.restated(t, acts))


_P = "account, symbol, currency"
_W = f"PARTITION BY {_P} ORDER BY date, pri, id ROWS UNBOUNDED PRECEDING"
LEDGER = f"""{RAW}, t0 AS (SELECT account, symbol, {CUR} AS currency, date, {ID} AS id, side, quantity, price, fee, tax FROM raw),
  acts AS (SELECT * FROM (SELECT DISTINCT {_P} FROM t0) k, (VALUES (DATE '1996-05-06', 'a1', 'split', 2.0, NULL), (DATE '1997-03-03', 'a2', 'dividend', NULL, 0.5), (DATE '1998-11-11', 'a3', 'split', 0.5, NULL), (DATE '1999-02-02', 'a4', 'dividend', NULL, 0.25), (DATE '2003-01-01', 'a5', 'split', 10.0, NULL)) AS a(date, id, kind, ratio, per_share)),
  ev AS (SELECT {_P}, date, 2 AS pri, id, 'trade' AS kind, side, quantity, price, fee, tax, 1.0::DOUBLE AS ratio, NULL::DOUBLE AS per_share FROM t0 UNION ALL SELECT {_P}, date, 1, id, kind, NULL, NULL, NULL, NULL, NULL, CASE WHEN kind = 'split' THEN ratio ELSE 1.0 END::DOUBLE, per_share::DOUBLE FROM acts),
  f AS (SELECT *, product(ratio) OVER ({_W}) AS factor FROM ev),
  h AS (SELECT *, sum(CASE WHEN kind <> 'trade' THEN 0.0 WHEN side = 'sell' THEN -quantity / factor ELSE quantity / factor END) OVER ({_W}) AS held FROM f),
  bad AS (SELECT DISTINCT {_P} FROM h WHERE kind = 'trade' AND held * factor < -1e-8),
  good AS (SELECT * FROM h WHERE (account, symbol, currency) NOT IN (SELECT (account, symbol, currency) FROM bad) AND date <= DATE '{AS_OF}'),
  b AS (SELECT *, sum(quantity / factor) OVER ({_W}) AS e, quantity / factor AS q, (quantity * price + fee + tax) / (quantity / factor) AS unit FROM good WHERE kind = 'trade' AND side = 'buy'),
  s AS (SELECT *, sum(quantity / factor) OVER ({_W}) AS e, quantity / factor AS q, (quantity * price - fee - tax) / (quantity / factor) AS unit FROM good WHERE kind = 'trade' AND side = 'sell'),
  last_factor AS (SELECT {_P}, arg_max(factor, (date, pri, id)) AS ff FROM good GROUP BY ALL),
  lot AS (SELECT b.account, b.symbol, b.currency, b.id, least(b.q, greatest(0.0, b.e - coalesce(z.sold, 0.0))) * ff AS remaining, b.unit / ff AS unit_cost FROM b JOIN last_factor USING (account, symbol, currency) LEFT JOIN (SELECT {_P}, sum(q) AS sold FROM s GROUP BY ALL) z USING (account, symbol, currency) WHERE least(b.q, greatest(0.0, b.e - coalesce(z.sold, 0.0))) > 1e-8),
  posn AS (SELECT {_P}, sum(remaining) AS quantity, sum(remaining * unit_cost) AS cost FROM lot GROUP BY ALL),
  real AS (SELECT s.account, s.symbol, s.currency, s.id, s.date, sum((least(b.e, s.e) - greatest(b.e - b.q, s.e - s.q)) * (s.unit - b.unit)) AS amount FROM s JOIN b ON b.account = s.account AND b.symbol = s.symbol AND b.currency = s.currency AND b.e - b.q < s.e AND s.e - s.q < b.e GROUP BY ALL)"""


@query(f"WITH {LEDGER} SELECT account, symbol, id AS buy_id, {R('remaining', 'unit_cost')} FROM lot")
def ledger_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lots(ledger.until(_ledger(spark, sf_dir), F.lit(AS_OF).cast("date"))).select("account", "symbol", "buy_id", *r("remaining", "unit_cost"))


@query(f"WITH {LEDGER}, d AS (SELECT account, symbol, date, held * factor * per_share AS amount FROM good WHERE kind = 'dividend' AND per_share > 0 AND held * factor > 1e-8) SELECT account, symbol, date, {R('amount')} FROM d")
def ledger_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dividends(ledger.until(_ledger(spark, sf_dir), F.lit(AS_OF).cast("date"))).select("account", "symbol", "date", *r("amount"))


@query(f"WITH {LEDGER}, g AS (SELECT account, symbol, count(*) AS sells, sum(amount) AS profit FROM real GROUP BY ALL) SELECT account, symbol, sells, {R('profit', digits=3)} FROM g")
def ledger_realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = ledger.realized(ledger.until(_ledger(spark, sf_dir), F.lit(AS_OF).cast("date")))
    return sold.groupBy("account", "symbol").agg(F.count("*").alias("sells"), F.sum("amount").alias("profit")).select("account", "symbol", "sells", *r("profit", digits=3))


def _converted(source: str) -> str:
    return f"""SELECT l.*, CASE WHEN abs(amount) <= 1e-8 THEN 0.0 WHEN currency = 'CNY' THEN amount ELSE amount * coalesce(d.rate, 1.0 / i.rate, 1.0) END AS converted,
    CASE WHEN currency = 'CNY' OR abs(amount) <= 1e-8 THEN false ELSE coalesce(d.is_stale, i.is_stale, true) END AS stale FROM {source} l
    ASOF LEFT JOIN (SELECT * FROM rates WHERE to_currency = 'CNY') d ON d.from_currency = l.currency AND l."on" >= d.rate_date ASOF LEFT JOIN (SELECT * FROM rates WHERE from_currency = 'CNY') i ON i.to_currency = l.currency AND l."on" >= i.rate_date"""


SNAPSHOT = f"""WITH {LEDGER}, {BARS}, {RATES_SQL}, cash_ AS (SELECT account, {CUR} AS currency, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount, o_orderstatus = 'P' AS out_ FROM (SELECT o_custkey % 10 AS account, * FROM orders)),
  bal AS (SELECT account, currency, DATE '{AS_OF}' AS "on", 'cash' AS kind, sum(amount) AS amount FROM (
    SELECT account, currency, CASE WHEN side = 'sell' THEN quantity * price - fee - tax ELSE -quantity * price - fee - tax END AS amount FROM good WHERE kind = 'trade'
    UNION ALL SELECT account, currency, CASE WHEN out_ THEN -amount ELSE amount END FROM cash_ WHERE date <= DATE '{AS_OF}'
    UNION ALL SELECT account, currency, held * factor * per_share FROM good WHERE kind = 'dividend' AND held * factor > 1e-8) GROUP BY ALL),
  hv AS (SELECT p.account, p.currency, DATE '{AS_OF}' AS "on", p.quantity * CASE WHEN c.close > 0 THEN c.close ELSE p.cost / p.quantity END AS value, p.cost FROM (SELECT *, DATE '{AS_OF}' AS d FROM posn) p ASOF LEFT JOIN bars c ON c.code = p.symbol AND p.d >= c.date),
  lines AS (SELECT account, currency, "on", kind, amount FROM bal UNION ALL SELECT account, currency, "on", 'value', value FROM hv UNION ALL SELECT account, currency, "on", 'cost', cost FROM hv UNION ALL SELECT account, currency, date, 'realized', amount FROM real
    UNION ALL SELECT account, currency, date, 'fee', fee FROM good WHERE kind = 'trade' UNION ALL SELECT account, currency, date, 'tax', tax FROM good WHERE kind = 'trade'),
  conv AS ({_converted('lines')}),
  tot AS (SELECT account, coalesce(sum(converted) FILTER (WHERE kind = 'cash'), 0.0) AS total_cash, coalesce(sum(converted) FILTER (WHERE kind = 'value'), 0.0) AS market_value, coalesce(sum(converted) FILTER (WHERE kind = 'cost'), 0.0) AS cost, coalesce(sum(converted) FILTER (WHERE kind = 'realized'), 0.0) AS realized_pnl,
    coalesce(sum(converted) FILTER (WHERE kind = 'fee'), 0.0) AS fee_total, coalesce(sum(converted) FILTER (WHERE kind = 'tax'), 0.0) AS tax_total, bool_or(stale) AS fx_stale FROM conv GROUP BY account),
  fin AS (SELECT *, total_cash + market_value AS equity, market_value - cost AS unrealized_pnl FROM tot)"""


@query(f"{SNAPSHOT} SELECT account, fx_stale, {R('total_cash', 'market_value', 'equity', 'realized_pnl', 'unrealized_pnl', 'fee_total', 'tax_total', digits=1)} FROM fin")
def portfolio_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts by first in, first out, with splits, dividends, cash and rates at each event's day."""
    rows = _ledger(spark, sf_dir)
    account = (F.col("o_custkey") % 10).alias("account")
    cash = table(spark, sf_dir, "orders").select(account, F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "out").otherwise("in").alias("direction"), F.col("o_totalprice").alias("amount")).withColumn("currency", currency())
    accounts = cash.select("account").distinct().withColumn("base", F.lit("CNY"))
    b = bars(spark, sf_dir).select(F.col("code").alias("symbol"), "date", "close")
    df = ledger.snapshot_of(accounts, cash, rows, b, rates(spark), F.lit(AS_OF).cast("date"))
    return df.select("account", "fx_stale", *r("total_cash", "market_value", "equity", "realized_pnl", "unrealized_pnl", "fee_total", "tax_total", digits=1))


LATER = "2001-06-30"
_AT = lambda day: LEDGER.replace(f"DATE '{AS_OF}'", f"DATE '{day}'")


def _state(day: str) -> str:
    return f"(WITH {_AT(day)} SELECT account, symbol, id, remaining, unit_cost FROM lot)"


@query(f"""WITH a AS MATERIALIZED {_state(AS_OF)}, b AS MATERIALIZED {_state(LATER)}, every AS (SELECT DISTINCT o_custkey % 10 AS account FROM orders),
  lots AS (SELECT * FROM a WHERE account % 2 = 1 UNION ALL SELECT * FROM b WHERE account % 2 = 0),
  snaps AS (SELECT account, DATE '{AS_OF}' AS date, (SELECT sum(remaining * unit_cost) FROM a WHERE a.account = e.account) AS cost FROM every e UNION ALL SELECT account, DATE '{LATER}', (SELECT sum(remaining * unit_cost) FROM b WHERE b.account = e.account) FROM every e WHERE account % 2 = 0),
  l AS (SELECT account, count(*) AS n_lots, count(DISTINCT symbol) AS n_positions, sum(remaining) AS quantity FROM lots GROUP BY account), s AS (SELECT account, count(*) AS n_days, max(date) AS newest, sum(cost) AS cost FROM snaps GROUP BY account)
SELECT s.account, n_lots, n_positions, n_days, newest, {R('quantity', 'cost', digits=2)} FROM s LEFT JOIN l ON l.account = s.account""")
def account_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts at one day, then every other account at a later one, each as one commit of positions, lots and snapshots."""
    rows = _ledger(spark, sf_dir)
    every = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("account")).distinct().withColumn("method", F.lit("fifo"))
    store = Versions(spark, scratch(spark, "accounts"))
    for day, some in ((AS_OF, F.lit(True)), (LATER, F.col("account") % 2 == 0)):
        on = F.lit(day).cast("date")
        lots = kept(ledger.lots(ledger.until(rows.where(some), on)).withColumn("method", F.lit("fifo")), "lots")
        held = lots.groupBy("account", "method", "symbol", "currency").agg(F.sum("remaining").alias("quantity"), F.sum(F.col("remaining") * F.col("unit_cost")).alias("cost"))
        cost = held.groupBy("account", "method").agg(F.sum("cost").alias("cost"))
        refreshed = every.where(some)
        ledger.refresh(store, refreshed, held, lots, refreshed.join(cost, ["account", "method"], "left").withColumn("date", on))
    v = store.version()
    lots = store.read("lots", v).groupBy("account").agg(F.count("*").alias("n_lots"))
    held = store.read("positions", v).groupBy("account").agg(F.countDistinct("symbol").alias("n_positions"), F.sum("quantity").alias("quantity"))
    days = store.read("snapshots", v).groupBy("account").agg(F.count("*").alias("n_days"), F.max("date").alias("newest"), F.sum("cost").alias("cost"))
    return days.join(lots, "account", "left").join(held, "account", "left").select("account", "n_lots", "n_positions", "n_days", "newest", *r("quantity", "cost", digits=2))
