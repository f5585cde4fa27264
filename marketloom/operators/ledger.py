"""Ledgers of cash, trades and corporate actions, for all accounts at once, with splits, dividends and currencies.

Events of a position (account, symbol, currency) are ordered by (date, priority, id): cash 0, corporate actions 1, trades 2.
A split multiplies what is held and divides its unit cost. With every quantity divided by the product of the splits until
then, splits vanish: holdings are running sums, lots are intervals of cumulative quantity, and a dividend pays the running sum
times that product. So the plan is made of windows over positions, without a fold; only average cost is one (see
portfolio.average_cost), over the trades of a position, which is bounded by what one account trades of one symbol.

Amounts are converted at the day of their event, balances and positions at the day of the snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import portfolio as p
from marketloom.operators.asof import asof
from marketloom.sources.versions import Versions, bucket, replace_keys
from marketloom.sources.writes import kept

POSITION = ("account", "symbol", "currency")


def until(ledger: DataFrame, as_of: Column, on: str = "date") -> DataFrame:
    return ledger.where(F.col(on) <= as_of)


def restated(trades: DataFrame, actions: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """trades: keys, date, id, side, quantity, price, fee, tax. actions: keys, date, id, kind (split or dividend), ratio,
    per_share. Both as rows of one ledger, with `factor`, the product of splits until then; trades also with quantity and
    price as they would be without splits; `held`, in those units, after each row."""
    t = trades.withColumns({"_priority": F.lit(2), "kind": F.lit("trade")})
    a = actions.withColumn("_priority", F.lit(1))
    rows = t.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("date", "_priority", "id").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when((F.col("kind") == "split") & (F.col("ratio") > 0), F.col("ratio")).otherwise(1.0)
    rows = rows.withColumn("factor", F.product(ratio).over(w))
    rows = rows.withColumns({"quantity": F.col("quantity") / F.col("factor"), "price": F.col("price") * F.col("factor")})
    signed = F.when(F.col("kind") == "trade", p.signed()).otherwise(0.0)
    return rows.withColumn("held", F.sum(signed).over(w))


def _oversells() -> Column:
    return (F.col("kind") == "trade") & (F.col("held") * F.col("factor") < -p.EPS)


def oversold(rows: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys of positions in which a sell takes more than is held, by the ledger with splits."""
    return rows.where(_oversells()).select(*keys).distinct()


def sound(rows: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """rows without the positions of oversold(), found where the rows are, with no join. What restated() adds depends on earlier rows only, so
    until() may follow."""
    return rows.withColumn("_bad", F.bool_or(_oversells()).over(Window.partitionBy(*keys))).where(~F.coalesce("_bad", F.lit(False))).drop("_bad")


def dividends(rows: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, date, amount of each dividend that is paid on something."""
    held = F.col("held") * F.col("factor")
    return rows.where((F.col("kind") == "dividend") & (F.col("per_share") > 0) & (held > p.EPS)).select(*keys, "date", (held * F.col("per_share")).alias("amount"))


def lots(rows: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, buy_id, remaining, unit_cost of the lots held at the end, first in first out, after all splits."""
    every = Window.partitionBy(*keys).orderBy("date", "_priority", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    trade, sell = F.col("kind") == "trade", F.col("side") == "sell"
    buy = trade & ~sell & (F.col("quantity") > 0)
    # windows of one order, so a position's rows are dealt and sorted once
    rows = rows.withColumn("_end", F.sum(F.when(buy, F.col("quantity"))).over(Window.partitionBy(*keys).orderBy("date", "_priority", "id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_factor": F.last("factor").over(every), "_sold": F.sum(F.when(trade & sell, F.col("quantity"))).over(every)}).where(buy)
    left = F.least("quantity", F.greatest(F.lit(0.0), F.col("_end") - F.coalesce("_sold", F.lit(0.0))))
    unit = (F.col("quantity") * F.col("price") + F.col("fee") + F.col("tax")) / F.col("quantity")
    return rows.withColumn("_left", left).where(F.col("_left") > p.EPS).select(*keys, F.col("id").alias("buy_id"), (F.col("_left") * F.col("_factor")).alias("remaining"), (unit / F.col("_factor")).alias("unit_cost"))


def positions(rows: DataFrame, method: str = "fifo", keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, quantity, cost, avg_cost of what is held at the end."""
    if method == "fifo":
        held = lots(rows, keys).groupBy(*keys).agg(F.sum("remaining").alias("quantity"), F.sum(F.col("remaining") * F.col("unit_cost")).alias("cost"))
    else:
        end = rows.groupBy(*keys).agg(F.max_by("factor", F.struct("date", "_priority", "id")).alias("_factor"))
        held = p.average_cost(rows.where("kind = 'trade'"), keys).join(end, list(keys)).select(*keys, (F.col("quantity") * F.col("_factor")).alias("quantity"), "cost").where(F.col("quantity") > p.EPS)
    return held.withColumn("avg_cost", F.try_divide("cost", "quantity"))


def realized(rows: DataFrame, method: str = "fifo", keys: Sequence[str] = POSITION) -> DataFrame:
    """keys, date, amount: the profit of each sell."""
    trades = rows.where("kind = 'trade'")
    if method == "fifo":
        # the sell's date goes with its id, so that matches needn't be joined to trades
        sold = p.fifo_matches(trades.withColumn("id", F.struct("date", "id")), keys).groupBy(*keys, "sell_id").agg((F.sum("proceeds") - F.sum("cost")).alias("amount"))
        return sold.select(*keys, "sell_id.date", "amount")
    return p.average_cost_sells(trades, keys)


def snapshot(accounts: DataFrame, cash: DataFrame, trades: DataFrame, actions: DataFrame, closes: DataFrame, rates: DataFrame, as_of: Column, method: str = "fifo") -> DataFrame:
    """accounts: account, base. cash: account, currency, date, direction (in or out), amount. closes: symbol, date, close.
    A row for each account: total_cash, market_value, equity, realized_pnl, unrealized_pnl, fee_total, tax_total in its base
    currency, and whether a rate was stale."""
    return snapshot_of(accounts, cash, restated(until(trades, as_of), until(actions, as_of)), closes, rates, as_of, method)


def snapshot_of(accounts: DataFrame, cash: DataFrame, rows: DataFrame, closes: DataFrame, rates: DataFrame, as_of: Column, method: str = "fifo") -> DataFrame:
    """snapshot() of a ledger as restated() gives it, whole or until as_of. Amounts are summed by account, currency and day before they are
    converted: those of a day have one rate."""
    cash = until(cash, as_of)
    # written once, as each kind of line would deal out the trades anew, with columns of its own
    rows = kept(until(rows, as_of).select(*POSITION, "date", "_priority", "id", "kind", "side", "quantity", "price", "fee", "tax", "factor", "held", "per_share"), "ledger")
    trades = rows.where("kind = 'trade'")
    gross = F.col("quantity") * F.col("price")
    charges = F.col("fee") + F.col("tax")
    moves = trades.select("account", "currency", F.when(F.col("side") == "sell", gross - charges).otherwise(-gross - charges).alias("amount"))
    moves = moves.unionByName(cash.select("account", "currency", F.when(F.col("direction") == "in", F.col("amount")).otherwise(-F.col("amount")).alias("amount")))
    moves = moves.unionByName(dividends(rows).select("account", "currency", "amount"))
    balances = moves.groupBy("account", "currency").agg(F.sum("amount").alias("amount")).withColumn("on", as_of)
    held = asof(positions(rows, method).withColumn("on", as_of), closes, ["symbol"], "on", "date", "_c")
    value = F.col("quantity") * F.when(F.col("_c.close") > 0, F.col("_c.close")).otherwise(F.col("avg_cost"))
    line = lambda df, kind, amount, on="date": df.select("account", "currency", F.lit(kind).alias("kind"), F.col(on).alias("on"), amount.alias("amount"))
    lines = line(balances, "cash", F.col("amount"), "on")
    for df, kind, amount, on in ((held, "value", value, "on"), (held, "cost", F.col("cost"), "on"), (realized(rows, method), "realized", F.col("amount"), "date"), (trades, "fee", F.col("fee"), "date"), (trades, "tax", F.col("tax"), "date")):
        lines = lines.unionByName(line(df, kind, amount, on))
    # a line of about nothing is worth nothing, and its rate doesn't count
    days = lines.where(F.abs("amount") > p.EPS).groupBy("account", "currency", "kind", "on").agg(F.sum("amount").alias("total"))
    done = p.to_base(days.join(accounts, "account").withColumn("amount", F.lit(1.0)), rates).withColumn("converted", F.col("total") * F.col("converted"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("converted"))), F.lit(0.0))
    sums = done.groupBy("account").agg(*(total(k).alias(k) for k in ("cash", "value", "cost", "realized", "fee", "tax")), F.bool_or("stale").alias("fx_stale"))
    out = accounts.join(sums, "account", "left").fillna(0.0, ["cash", "value", "cost", "realized", "fee", "tax"])
    return out.select(
        "account", F.col("cash").alias("total_cash"), F.col("value").alias("market_value"), (F.col("cash") + F.col("value")).alias("equity"), F.col("realized").alias("realized_pnl"),
        (F.col("value") - F.col("cost")).alias("unrealized_pnl"), F.col("fee").alias("fee_total"), F.col("tax").alias("tax_total"), F.coalesce("fx_stale", F.lit(False)).alias("fx_stale"),
    )


def refresh(store: Versions, accounts: DataFrame, positions: DataFrame, lots: DataFrame, snapshots: DataFrame) -> int:
    """accounts: account, method that were computed anew. Their positions and lots are replaced, those that have none now included, and
    their snapshot of the day (account, method, date) is added or replaced: one commit for the three tables, so that a reader never sees
    lots of one state beside positions of another."""
    key = ["account", "method"]
    days = snapshots.select(*key, "date")
    tables = {"positions": (positions, key, bucket), "lots": (lots, key, bucket), "snapshots": (snapshots, [*key, "date"], bucket)}
    return replace_keys(store, tables, {"positions": accounts, "lots": accounts, "snapshots": days}, "account")
