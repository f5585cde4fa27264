"""Queries on portfolios. Ten accounts trade suppliers' bars; ledgers end before they would be oversold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.operators import portfolio as p
from marketloom.plans.registry import ORACLES, query
from marketloom.sources.testdata import BARS, INSTRUMENTS, bars, instruments, table


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = line.join(orders, line.l_orderkey == orders.o_orderkey)
    gross = F.col("l_extendedprice")
    one = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return j.select(
        (F.col("o_custkey") % 10).alias("account"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.to_date("l_shipdate").alias("date"), one.alias("id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("quantity"), (gross / F.col("l_quantity")).alias("price"),
        (gross * F.col("l_discount") / 100).alias("fee"), F.when(F.col("l_returnflag") == "R", gross * F.col("l_tax") / 100).otherwise(0.0).alias("tax"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.sell_validation(raw_trades(spark, sf_dir)).where("not oversold").drop("oversold")


_O = "PARTITION BY account, symbol ORDER BY date, k1, k2, k3, k5 ROWS UNBOUNDED PRECEDING"
RAW = """raw AS (SELECT o_custkey % 10 AS account, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_extendedprice AS k5,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice * l_discount / 100 AS fee, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax / 100 ELSE 0.0 END AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TRADES = f"""{RAW}, held_ AS (SELECT *, sum(CASE WHEN side = 'sell' THEN -quantity ELSE quantity END) OVER ({_O}) AS held FROM raw),
  chk AS (SELECT *, min(held) OVER ({_O}) < -1e-8 AS oversold FROM held_), trades AS (SELECT * FROM chk WHERE NOT oversold)"""
BUYS = f"""buys AS (SELECT *, sum(quantity) OVER ({_O}) AS e, (quantity * price + fee + tax) / quantity AS unit FROM trades WHERE side = 'buy'), sells AS (SELECT *, sum(quantity) OVER ({_O}) AS e, (quantity * price - fee - tax) / quantity AS unit FROM trades WHERE side = 'sell'),
  lots AS (SELECT b.account, b.symbol, b.k1, b.k2, b.k3, b.k5, least(quantity, greatest(0, e - coalesce(sold, 0))) AS remaining, unit AS unit_cost FROM buys b LEFT JOIN (SELECT account, symbol, sum(quantity) AS sold FROM sells GROUP BY ALL) s ON b.account = s.account AND b.symbol = s.symbol),
  pos AS (SELECT account, symbol, sum(remaining) AS quantity, sum(remaining * unit_cost) AS cost, sum(remaining * unit_cost) / sum(remaining) AS avg_cost FROM lots WHERE remaining > 1e-8 GROUP BY account, symbol),
  matched AS (SELECT b.account, b.symbol, b.k1 AS b1, s.k1 AS s1, least(b.e, s.e) - greatest(b.e - b.quantity, s.e - s.quantity) AS q, b.unit AS bu, s.unit AS su FROM buys b JOIN sells s ON b.account = s.account AND b.symbol = s.symbol AND b.e - b.quantity < s.e AND s.e - s.quantity < b.e)"""


@query(f"WITH {RAW}, h AS (SELECT *, sum(CASE WHEN side = 'sell' THEN -quantity ELSE quantity END) OVER ({_O}) AS held FROM raw), c AS (SELECT *, min(held) OVER ({_O}) < -1e-8 AS oversold FROM h) SELECT account, symbol, count(*) AS trades, count(*) FILTER (WHERE oversold) AS rejected FROM c GROUP BY account, symbol")
def sell_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.sell_validation(raw_trades(spark, sf_dir)).groupBy("account", "symbol").agg(F.count("*").alias("trades"), F.count_if("oversold").alias("rejected"))


@query(f"WITH {TRADES}, {BUYS} SELECT account, symbol, k1 AS buy_order, remaining, {R('unit_cost')} FROM lots WHERE remaining > 1e-8")
def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.fifo_lots(trades(spark, sf_dir)).select("account", "symbol", F.col("buy_id.l_orderkey").alias("buy_order"), "remaining", *r("unit_cost"))


@query(f"WITH {TRADES}, {BUYS}, m AS (SELECT account, symbol, b1 AS buy_order, s1 AS sell_order, q AS quantity, q * bu AS cost, q * su AS proceeds FROM matched) SELECT account, symbol, buy_order, sell_order, quantity, {R('cost', 'proceeds', digits=3)} FROM m")
def fifo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.fifo_matches(trades(spark, sf_dir)).select("account", "symbol", F.col("buy_id.l_orderkey").alias("buy_order"), F.col("sell_id.l_orderkey").alias("sell_order"), "quantity", *r("cost", "proceeds", digits=3))


@query(f"WITH {TRADES}, {BUYS} SELECT account, symbol, quantity, {R('cost', 'avg_cost', digits=3)} FROM pos")
def fifo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.positions(trades(spark, sf_dir)).select("account", "symbol", "quantity", *r("cost", "avg_cost", digits=3))


@query(f"WITH {TRADES}, {BUYS}, g AS (SELECT account, symbol, sum(q) AS sold, sum(q * su) - sum(q * bu) AS realized_pnl FROM matched GROUP BY account, symbol) SELECT account, symbol, sold, {R('realized_pnl', digits=3)} FROM g")
def realized_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.realized(trades(spark, sf_dir)).select("account", "symbol", "sold", *r("realized_pnl", digits=3))


@query(f"""WITH RECURSIVE {TRADES}, seq AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY date, k1, k2, k3, k5) AS n FROM trades), fold AS (
  SELECT account, symbol, n, quantity AS q, quantity * price + fee + tax AS cost, 0.0::DOUBLE AS pnl FROM seq WHERE n = 1
  UNION ALL
  SELECT f.account, f.symbol, s.n, CASE WHEN side = 'buy' THEN q + quantity WHEN abs(q - quantity) < 1e-8 THEN 0.0 ELSE q - quantity END,
    CASE WHEN side = 'buy' THEN cost + quantity * price + fee + tax WHEN abs(q - quantity) < 1e-8 THEN 0.0 ELSE cost - cost * quantity / q END,
    CASE WHEN side = 'buy' THEN pnl ELSE pnl + quantity * price - fee - tax - CASE WHEN q > 1e-8 THEN cost * quantity / q ELSE 0.0 END END
  FROM fold f JOIN seq s ON f.account = s.account AND f.symbol = s.symbol AND s.n = f.n + 1
), fin AS (SELECT account, symbol, q AS quantity, cost, pnl AS realized_pnl FROM fold QUALIFY row_number() OVER (PARTITION BY account, symbol ORDER BY n DESC) = 1)
SELECT account, symbol, quantity, {R('cost', 'realized_pnl', digits=3)} FROM fin""")
def avg_cost_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.average_cost(trades(spark, sf_dir)).select("account", "symbol", "quantity", *r("cost", "realized_pnl", digits=3))


_BASE, _NEXT = ORACLES["avg_cost_positions"].split("UNION ALL\n  SELECT f.account")
_SELLS = _BASE.replace("SELECT account, symbol, n, quantity AS q,", "SELECT account, symbol, n, date, side, quantity AS q,") + "UNION ALL\n  SELECT f.account" + _NEXT.replace("f.symbol, s.n, CASE", "f.symbol, s.n, s.date, s.side, CASE").replace("WHEN side =", "WHEN s.side =")


@query(_SELLS[: _SELLS.index(", fin AS")] + f", g AS (SELECT account, symbol, date, pnl - lag(pnl, 1, 0.0) OVER (PARTITION BY account, symbol ORDER BY n) AS amount, side FROM fold), d AS (SELECT account, symbol, date, sum(amount) AS profit FROM g WHERE side = 'sell' GROUP BY ALL) SELECT account, symbol, date, {R('profit', digits=2)} FROM d")
def average_sells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profit of each day's sells by average cost."""
    sold = p.average_cost_sells(trades(spark, sf_dir))
    return sold.groupBy("account", "symbol", "date").agg(F.sum("amount").alias("profit")).select("account", "symbol", "date", *r("profit", digits=2))


RATES = [("USD", "CNY", "1996-01-01", 8.3, False), ("USD", "CNY", "1998-06-01", 8.28, False), ("USD", "CNY", "2000-01-01", 8.27, True), ("CNY", "HKD", "1995-01-01", 0.92, False), ("CNY", "HKD", "1999-01-01", 0.94, False)]
RATES_SQL = "rates AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', DATE '{d}', {x}::DOUBLE, {str(s).lower()})" for a, b, d, x, s in RATES) + ") AS t(from_currency, to_currency, rate_date, rate, is_stale))"


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "from_currency string, to_currency string, rate_date string, rate double, is_stale boolean").withColumn("rate_date", F.to_date("rate_date"))


def currency():
    return F.when(F.col("account") % 4 == 0, "CNY").when(F.col("account") % 4 == 1, "USD").when(F.col("account") % 4 == 2, "HKD").otherwise("EUR")


CUR = "CASE account % 4 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' WHEN 2 THEN 'HKD' ELSE 'EUR' END"
FX = f"""{RATES_SQL}, am AS (SELECT account, symbol, k1, date AS "on", quantity * price AS amount, {CUR} AS currency FROM trades), fx AS (
  SELECT a.*, d.rate AS dr, i.rate AS ir, d.is_stale AS ds, i.is_stale AS is_ FROM am a ASOF LEFT JOIN (SELECT * FROM rates WHERE to_currency = 'CNY') d ON d.from_currency = a.currency AND a."on" >= d.rate_date
  ASOF LEFT JOIN (SELECT * FROM rates WHERE from_currency = 'CNY') i ON i.to_currency = a.currency AND a."on" >= i.rate_date
), conv AS (SELECT account, symbol, k1, currency, "on", amount, CASE WHEN abs(amount) <= 1e-8 THEN 0.0 WHEN currency = 'CNY' THEN amount ELSE amount * coalesce(dr, 1.0 / ir, 1.0) END AS converted, CASE WHEN currency = 'CNY' OR abs(amount) <= 1e-8 THEN false ELSE coalesce(ds, is_, true) END AS stale FROM fx)"""


@query(f'WITH {TRADES}, {FX} SELECT account, symbol, k1 AS order_id, currency, "on", {R("converted", digits=3)}, stale FROM conv')
def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("account", "symbol", F.col("id.l_orderkey").alias("order_id"), F.col("date").alias("on"), (F.col("quantity") * F.col("price")).alias("amount"), currency().alias("currency"))
    return p.to_currency(t, rates(spark)).select("account", "symbol", "order_id", "currency", "on", *r("converted", digits=3), "stale")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select(F.col("code").alias("symbol"), "date", "close")
    return p.valued(p.positions(trades(spark, sf_dir)).withColumn("on", F.lit("2000-06-30").cast("date")), b)


HELD = f"""{BARS}, {TRADES}, {BUYS}, held AS (
  SELECT p.*, CASE WHEN b.close > 0 THEN b.close ELSE p.avg_cost END AS price, p.quantity * CASE WHEN b.close > 0 THEN b.close ELSE p.avg_cost END AS market_value
  FROM (SELECT *, DATE '2000-06-30' AS "on" FROM pos) p ASOF LEFT JOIN bars b ON b.code = p.symbol AND p."on" >= b.date
)"""


@query(f"""WITH {HELD}, {RATES_SQL}, acc AS (SELECT account, {CUR} AS currency, sum(market_value) AS mv, sum(cost) AS cost FROM held GROUP BY account), rt AS (
  SELECT a.*, CASE WHEN currency = 'CNY' THEN 1.0 WHEN currency = 'USD' THEN 8.27 WHEN currency = 'HKD' THEN 1.0 / 0.94 ELSE 1.0 END AS rate, currency IN ('USD', 'EUR') AS stale FROM acc a
), tot AS (SELECT count(*) AS accounts, sum(mv * rate) AS market_value, sum((mv - cost) * rate) AS unrealized_pnl, bool_or(stale) AS fx_stale FROM rt) SELECT accounts, {R('market_value', 'unrealized_pnl', digits=1)}, fx_stale FROM tot""")
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = _held(spark, sf_dir).groupBy("account", "on").agg(F.sum("market_value").alias("mv"), F.sum("cost").alias("cost")).withColumn("currency", currency())
    mv = p.to_currency(acc.withColumn("amount", F.col("mv")), rates(spark)).withColumn("mv_cny", F.col("converted")).drop("converted", "stale")
    both = p.to_currency(mv.withColumn("amount", F.col("mv") - F.col("cost")), rates(spark))
    return both.agg(F.count("*").alias("accounts"), F.sum("mv_cny").alias("market_value"), F.sum("converted").alias("unrealized_pnl"), F.bool_or("stale").alias("fx_stale")).select("accounts", *r("market_value", "unrealized_pnl", digits=1), "fx_stale")


@query(f"WITH {HELD}, g AS (SELECT symbol AS name, sum(market_value) AS market_value, count(DISTINCT symbol) AS symbols, sum(market_value) * 100 / (SELECT sum(market_value) FROM held) AS weight_pct FROM held GROUP BY symbol ORDER BY weight_pct DESC, name LIMIT 10) SELECT name, symbols, {R('market_value', digits=1)}, {R('weight_pct')}, weight_pct >= 2 AS alert FROM g")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.concentration(_held(spark, sf_dir), "symbol", threshold=2.0).select("name", "symbols", *r("market_value", digits=1), *r("weight_pct"), "alert")


@query(f"WITH {HELD}, {INSTRUMENTS}, h AS (SELECT h.*, coalesce(industry, 'UNCLASSIFIED') AS sector FROM held h LEFT JOIN instruments i ON i.code = h.symbol), g AS (SELECT upper(sector) AS name, sum(market_value) AS market_value, count(DISTINCT symbol) AS symbols, sum(market_value) * 100 / (SELECT sum(market_value) FROM held) AS weight_pct FROM h GROUP BY 1 ORDER BY weight_pct DESC, name LIMIT 10) SELECT name, symbols, {R('market_value', digits=1)}, {R('weight_pct')}, weight_pct >= 20 AS alert FROM g")
def sector_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = instruments(spark, sf_dir).select(F.col("code").alias("symbol"), F.col("industry").alias("sector"))
    held = _held(spark, sf_dir).join(sectors, "symbol", "left").fillna({"sector": "UNCLASSIFIED"})
    return p.concentration(held, "sector").select("name", "symbols", *r("market_value", digits=1), *r("weight_pct"), "alert")


@query(f"WITH {HELD}, l AS (SELECT account, symbol, (avg_cost - price) * 100 / avg_cost AS loss_pct FROM held), m AS (SELECT * FROM l WHERE loss_pct >= 10 ORDER BY loss_pct DESC, account, symbol LIMIT 20) SELECT account, symbol, {R('loss_pct')} FROM m")
def stop_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.stop_loss(_held(spark, sf_dir)).select("account", "symbol", *r("loss_pct"))


DAYS = "days AS (SELECT CAST(unnest(generate_series(DATE '1995-03-01', DATE '2001-06-01', INTERVAL 30 DAY)) AS DATE) AS \"on\")"
SERIES = f"""{BARS}, {TRADES}, {DAYS}, grid AS (SELECT account, symbol, "on" FROM (SELECT account, symbol, min(date) AS f FROM trades GROUP BY account, symbol) l JOIN days ON "on" >= f),
  lastq AS (SELECT account, symbol, date, held FROM trades QUALIFY row_number() OVER (PARTITION BY account, symbol, date ORDER BY k1 DESC, k2 DESC, k3 DESC, k5 DESC) = 1),
  g1 AS (SELECT g.*, t.held FROM grid g ASOF JOIN lastq t ON g.account = t.account AND g.symbol = t.symbol AND g."on" >= t.date),
  series AS (SELECT account, "on", sum(held * coalesce(b.close, 0.0)) AS value FROM g1 ASOF LEFT JOIN bars b ON b.code = g1.symbol AND g1."on" >= b.date GROUP BY account, "on")"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE'1995-03-01', DATE'2001-06-01', INTERVAL 30 DAY)) AS `on`")
    return p.value_series(trades(spark, sf_dir), bars(spark, sf_dir).select(F.col("code").alias("symbol"), "date", "close"), days)


@query(f'WITH {SERIES} SELECT account, "on", {R("value", digits=1)} FROM series')
def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("account", "on", *r("value", digits=1))


@query(f"""WITH {SERIES}, t AS (SELECT "on", sum(value) AS value FROM series GROUP BY "on"), k AS (SELECT *, greatest(0.0, max(value) OVER (ORDER BY "on")) AS peak FROM t), d AS (SELECT *, (peak - value) * 100 / peak AS dd FROM k),
  e AS (SELECT max(peak) AS peak, arg_max(value, "on") AS value, max(dd) AS max_drawdown_pct, arg_max(dd, "on") AS current_drawdown_pct FROM d) SELECT {R('peak', 'value', digits=1)}, {R('max_drawdown_pct', 'current_drawdown_pct')} FROM e""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _series(spark, sf_dir).groupBy("on").agg(F.sum("value").alias("value"))
    return p.drawdown(total).select(*r("peak", "value", digits=1), *r("max_drawdown_pct", "current_drawdown_pct"))
