"""Portfolio ledgers: lots, average cost, FX, valuation and risk, for all accounts in one plan.

Events are ordered by (date, priority, id): cash 0, corporate action 1, trade 2. Quantities are doubles, as in the ledgers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.asof import asof
from marketloom.operators.scan import closed, opened, scanned
from marketloom.sources.writes import kept

POSITION = ("account", "symbol")
EPS = 1e-8


def signed(side: str = "side", quantity: str = "quantity") -> Column:
    return F.when(F.col(side) == "sell", -F.col(quantity)).otherwise(F.col(quantity))


def sell_validation(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Adds `held` after each trade and `oversold`: whether holdings were negative at it or before."""
    w = Window.partitionBy(*keys).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("held", F.sum(signed()).over(w)).withColumn("oversold", F.min("held").over(w) < -EPS)


def fifo_matches(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, buy_id, sell_id, quantity, cost, proceeds: which lot each sold share came from.

    Buys and sells are intervals of cumulative quantity; the ends of both, in one order, cut them into pieces that belong
    to one buy and one sell each. So the work grows with the number of trades, not with pairs. Ledgers must not be oversold.
    Unit cost holds fee and tax, proceeds are net of both."""
    w = Window.partitionBy(*keys, "side").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    gross = F.col("quantity") * F.col("price")
    unit = F.when(F.col("side") == "sell", gross - F.col("fee") - F.col("tax")).otherwise(gross + F.col("fee") + F.col("tax")) / F.col("quantity")
    t = trades.where("quantity > 0").withColumns({"end": F.sum("quantity").over(w), "unit": unit})
    trade = F.struct("id", "unit")
    t = t.withColumns({"b": F.when(F.col("side") != "sell", trade), "s": F.when(F.col("side") == "sell", trade)})
    order = Window.partitionBy(*keys).orderBy("end", "side", "id")
    on = order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns({"begin": F.coalesce(F.lag("end").over(order), F.lit(0.0)), "buy": F.first("b", ignorenulls=True).over(on), "sell": F.first("s", ignorenulls=True).over(on)})
    t = t.where((F.col("end") - F.col("begin") > EPS) & F.col("buy").isNotNull() & F.col("sell").isNotNull())
    q = F.col("end") - F.col("begin")
    return t.select(*keys, F.col("buy.id").alias("buy_id"), F.col("sell.id").alias("sell_id"), q.alias("quantity"), (q * F.col("buy.unit")).alias("cost"), (q * F.col("sell.unit")).alias("proceeds"))


def fifo_lots(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, buy_id, remaining, unit_cost of the lots that are still held."""
    w = Window.partitionBy(*keys).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    buys = trades.where("side <> 'sell' and quantity > 0").withColumn("end", F.sum("quantity").over(w))
    sold = trades.where("side = 'sell'").groupBy(*keys).agg(F.sum("quantity").alias("sold"))
    remaining = F.least("quantity", F.greatest(F.lit(0.0), F.col("end") - F.coalesce("sold", F.lit(0.0))))
    df = buys.join(sold, list(keys), "left").withColumn("remaining", remaining).where(F.col("remaining") > EPS)
    return df.select(*keys, F.col("id").alias("buy_id"), "remaining", ((F.col("quantity") * F.col("price") + F.col("fee") + F.col("tax")) / F.col("quantity")).alias("unit_cost"))


def positions(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    lots = fifo_lots(trades, keys).groupBy(*keys).agg(F.sum("remaining").alias("quantity"), F.sum(F.col("remaining") * F.col("unit_cost")).alias("cost"))
    return lots.withColumn("avg_cost", F.try_divide("cost", "quantity"))


def realized(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    return fifo_matches(trades, keys).groupBy(*keys).agg(F.sum("quantity").alias("sold"), F.sum("proceeds").alias("proceeds"), (F.sum("proceeds") - F.sum("cost")).alias("realized_pnl"))


def by_average(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """events: keys, order, kind (buy, sell, split; others change nothing), quantity, price, charges, ratio. Adds n, held, cost and their values
    before the event, and `part`, the cost of what a sell takes: its share of the cost. What is held is a linear recurrence, and once it is
    known the cost is one; a position that is sold out starts anew."""
    rows = opened(kept(events, "events"), keys, order)
    opens, kind = F.col("_opens") == 0, F.col("kind")
    of = lambda c: F.coalesce(c, F.lit(0.0))
    change = F.when(kind == "buy", of("quantity")).when(kind == "sell", -of("quantity")).otherwise(0.0)
    rows = scanned(rows, F.when(opens, 0.0).when(kind == "split", F.col("ratio")).otherwise(1.0), F.when(opens, 0.0).otherwise(change), "held")
    share = F.when(F.col("held_before") > EPS, of("quantity") / F.col("held_before")).otherwise(0.0)
    left = F.when(opens | ((kind == "sell") & (F.abs("held") < EPS)), 0.0).when(kind == "sell", 1 - share).otherwise(1.0)
    paid = F.when(~opens & (kind == "buy"), of(F.col("quantity") * F.col("price")) + of("charges")).otherwise(0.0)
    rows = closed(scanned(rows, left, paid, "cost"))
    none = F.abs("held") < EPS
    return rows.withColumns({"part": F.when(kind == "sell", F.col("cost_before") * share).otherwise(0.0), "held": F.when(none, 0.0).otherwise(F.col("held"))})


def _events(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trades.select(*keys, "date", "id", F.when(F.col("side") == "sell", "sell").otherwise("buy").alias("kind"), "quantity", "price", (F.col("fee") + F.col("tax")).alias("charges"), F.lit(1.0).alias("ratio"))


#: Most trades of a ledger that is folded as one array.
MOST_FOLDED = 4096


def average_cost(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, quantity, cost, realized_pnl by average cost. Ledgers of up to MOST_FOLDED trades are folds over an array; larger ones go
    through scans, with the same result."""
    trades = trades.select(*keys, "date", "id", "side", "quantity", "price", "fee", "tax")
    sizes = trades.groupBy(*keys).count()
    large = kept(sizes.where(F.col("count") > MOST_FOLDED).select(*(F.col(k).alias(f"_{k}") for k in keys)), "large")
    if large.isEmpty():
        return _folded(trades, keys)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return _folded(trades.join(large, same, "left_anti"), keys).unionByName(_scanned(trades.join(large, same, "left_semi"), keys))


def _folded(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    event = F.struct("date", "id", signed().alias("q"), (F.col("quantity") * F.col("price")).alias("gross"), (F.col("fee") + F.col("tax")).alias("charges"))
    events = trades.groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("events"))
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("pnl"))

    def step(a: Column, e: Column) -> Column:
        part = F.when(a["q"] > EPS, a["cost"] * (-e["q"]) / a["q"]).otherwise(0.0)
        left = a["q"] + e["q"]
        sold = F.struct(F.when(F.abs(left) < EPS, 0.0).otherwise(left).alias("q"), F.when(F.abs(left) < EPS, 0.0).otherwise(a["cost"] - part).alias("cost"), (a["pnl"] + e["gross"] - e["charges"] - part).alias("pnl"))
        return F.when(e["q"] < 0, sold).otherwise(F.struct(left.alias("q"), (a["cost"] + e["gross"] + e["charges"]).alias("cost"), a["pnl"].alias("pnl")))

    df = events.withColumn("end", F.aggregate("events", zero, step))
    return df.select(*keys, F.col("end.q").alias("quantity"), F.col("end.cost").alias("cost"), F.col("end.pnl").alias("realized_pnl"))


def _scanned(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = by_average(_events(trades, keys), keys, ("date", "id"))
    profit = F.when(F.col("kind") == "sell", F.col("quantity") * F.col("price") - F.col("charges") - F.col("part"))
    df = rows.groupBy(*keys).agg(F.max_by(F.struct("held", "cost"), "n").alias("end"), F.coalesce(F.sum(profit), F.lit(0.0)).alias("realized_pnl"))
    return df.select(*keys, F.col("end.held").alias("quantity"), F.col("end.cost").alias("cost"), "realized_pnl")


def average_cost_sells(trades: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, date, amount: the profit of each sell by average cost."""
    rows = by_average(_events(trades, keys), keys, ("date", "id")).where("kind = 'sell'")
    return rows.select(*keys, "date", (F.col("quantity") * F.col("price") - F.col("charges") - F.col("part")).alias("amount"))


#: Parts that the amounts of a currency and month are dealt to; the few rates of the month stand in each.
SALT = 8


def _rate_at(amounts: DataFrame, rates: DataFrame, take: str) -> DataFrame:
    """amounts: currency, base, on. Adds `take`: the latest rate of (currency, base) by then. Rates are spread over the months in
    which they hold, so that months are partitions of their own."""
    keys = ("currency", "base")
    newest = F.lit(rates.agg(F.trunc(F.max("rate_date"), "month")).first()[0]).cast("date")  # of a small table
    after = F.lead("rate_date").over(Window.partitionBy(*keys).orderBy("rate_date"))
    months = F.explode(F.sequence(F.trunc("rate_date", "month"), F.when(F.col("_after").isNull(), newest).otherwise(F.greatest(F.trunc("rate_date", "month"), F.trunc(F.date_sub("_after", 1), "month"))), F.expr("interval 1 month")))
    held = rates.withColumn("_after", after).select(*keys, "rate_date", "rate", "is_stale", months.alias("month")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    df = amounts.withColumns({"month": F.least(F.trunc("on", "month"), newest), "salt": F.pmod(F.xxhash64("on", "amount", "currency"), F.lit(SALT)).cast("int")})
    return asof(df, held, [*keys, "month", "salt"], "on", "rate_date", take).drop("month", "salt")


def to_base(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts: currency, base, on, amount. Adds converted and stale: the latest direct rate by then, else one over the latest
    inverse, else 1 and stale; a rate that isn't positive doesn't count. Nothing is converted in the same currency; amounts
    about zero give 0."""
    direct = rates.select(F.col("from_currency").alias("currency"), F.col("to_currency").alias("base"), "rate_date", "rate", "is_stale")
    inverse = rates.select(F.col("to_currency").alias("currency"), F.col("from_currency").alias("base"), "rate_date", "rate", "is_stale")
    df = _rate_at(_rate_at(amounts, direct, "_d"), inverse, "_i")
    same, small = F.col("currency") == F.col("base"), F.abs("amount") <= EPS
    d, i = F.when(F.col("_d.rate") > 0, F.col("_d.rate")), F.when(F.col("_i.rate") > 0, F.col("_i.rate"))
    rate = F.coalesce(d, 1.0 / i, F.lit(1.0))
    stale = F.when(d.isNotNull(), F.col("_d.is_stale")).when(i.isNotNull(), F.col("_i.is_stale")).otherwise(True)
    return df.withColumn("converted", F.when(small, 0.0).when(same, F.col("amount")).otherwise(F.col("amount") * rate)).withColumn("stale", F.when(small | same, False).otherwise(stale)).drop("_d", "_i")


def to_currency(amounts: DataFrame, rates: DataFrame, to: str = "CNY") -> DataFrame:
    """to_base() with one base for all."""
    return to_base(amounts.withColumn("base", F.lit(to)), rates).drop("base")


def valued(held: DataFrame, closes: DataFrame) -> DataFrame:
    """held: account, symbol, quantity, cost, avg_cost, on. closes: symbol, date, close. Adds price, market_value and
    unrealized_pnl; a close that is missing or not positive gives way to the average cost."""
    df = asof(held, closes, ["symbol"], "on", "date", "_c")
    price = F.when(F.col("_c.close") > 0, F.col("_c.close")).otherwise(F.col("avg_cost"))
    df = df.withColumn("price", price).withColumn("market_value", F.col("quantity") * F.col("price"))
    return df.withColumn("unrealized_pnl", F.col("market_value") - F.col("cost")).drop("_c")


def concentration(held: DataFrame, by: str, threshold: float = 20.0, top: int = 10) -> DataFrame:
    """The largest shares of market value by a column, and whether each reaches the threshold."""
    g = held.groupBy(F.upper(by).alias("name")).agg(F.sum("market_value").alias("market_value"), F.countDistinct("symbol").alias("symbols"))
    total = held.agg(F.sum("market_value").alias("total"))  # one row
    g = g.join(F.broadcast(total)).withColumn("weight_pct", F.when(F.col("total") > 0, F.col("market_value") * 100 / F.col("total")).otherwise(0.0))
    return g.orderBy(F.desc("weight_pct"), "name").limit(top).select("name", "market_value", "symbols", "weight_pct", (F.col("weight_pct") >= threshold).alias("alert"))


def stop_loss(held: DataFrame, threshold: float = 10.0, top: int = 20) -> DataFrame:
    """Positions that are down most against their cost."""
    loss = F.try_divide((F.col("avg_cost") - F.col("price")) * 100, "avg_cost")
    return held.withColumn("loss_pct", loss).where(F.col("loss_pct") >= threshold).orderBy(F.desc("loss_pct"), "account", "symbol").limit(top).select("account", "symbol", "loss_pct")


def value_series(trades: DataFrame, closes: DataFrame, days: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """account, on, value: market value of each account on each of `days` (a column `on`), as of then. Days are a calendar,
    so every ledger meets every day; the product is what is asked for."""
    ledger = trades.groupBy(*keys).agg(F.min("date").alias("from"))
    grid = ledger.join(F.broadcast(days), F.col("on") >= F.col("from")).drop("from")
    w = Window.partitionBy(*keys).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    held = trades.withColumn("held", F.sum(signed()).over(w)).select(*keys, "date", "id", "held")
    df = asof(grid, held, list(keys), "on", "date", "_h", tie=["id"])
    df = asof(df.withColumn("quantity", F.col("_h.held")).drop("_h"), closes, ["symbol"], "on", "date", "_c")
    return df.groupBy("account", "on").agg(F.sum(F.col("quantity") * F.coalesce("_c.close", F.lit(0.0))).alias("value"))


def drawdown(series: DataFrame) -> DataFrame:
    """series: on, value of all accounts together. One row: peak, last value, current and greatest drawdown in percent."""
    # a row for each day of the calendar: one ordered pass
    w = Window.partitionBy(F.lit(1)).orderBy("on").rowsBetween(Window.unboundedPreceding, 0)
    df = series.withColumn("peak", F.greatest(F.lit(0.0), F.max("value").over(w)))
    df = df.withColumn("dd", F.when(F.col("peak") > 0, (F.col("peak") - F.col("value")) * 100 / F.col("peak")).otherwise(0.0))
    return df.agg(F.max("peak").alias("peak"), F.max_by("value", "on").alias("value"), F.max("dd").alias("max_drawdown_pct"), F.max_by("dd", "on").alias("current_drawdown_pct"))
