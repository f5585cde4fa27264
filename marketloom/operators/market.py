"""Market-wide measures: breadth, sector ranking, chip distribution, dividends, fundamental status, event lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.codes import is_bse, is_growth_board, is_st


def limit_ratio(code: Column, name: Column) -> Column:
    """Daily price limit by board; the first that fits."""
    return F.when(is_bse(code), 0.30).when(is_growth_board(code), 0.20).when(is_st(name), 0.05).otherwise(0.10)


def limit_hit(price: Column, before: Column, ratio: Column, up: bool) -> Column:
    """Whether the price is at the limit, rounded half up to cents, within what that rounding moved it."""
    raw = before * (1 + ratio) if up else before * (1 - ratio)
    limit = F.floor(raw * 100 + 0.5) / 100
    return F.abs(price - limit) <= F.floor(F.abs(raw - limit) * 1e10 + 0.5) / 1e10


def breadth(quotes: DataFrame) -> DataFrame:
    """quotes: code, name, last, prev_close, amount (strings or numbers). One row of counts. Rows without a price or with no
    amount are suspended and not counted; an unknown amount doesn't suspend. The total amount, in 1e8, is over all rows."""
    n = lambda c: F.try_cast(F.col(c), "double") if hasattr(F, "try_cast") else F.expr(f"try_cast({c} as double)")
    q = quotes.select("code", "name", n("last").alias("p"), n("prev_close").alias("b"), n("amount").alias("a"))
    live = F.col("p").isNotNull() & F.col("b").isNotNull() & (F.coalesce("a", F.lit(1.0)) != 0)
    ratio = limit_ratio(F.col("code"), F.col("name"))
    return q.agg(
        F.count_if(live & (F.col("p") > F.col("b"))).alias("up"), F.count_if(live & (F.col("p") < F.col("b"))).alias("down"), F.count_if(live & (F.col("p") == F.col("b"))).alias("flat"),
        F.count_if(live & (F.col("p") > F.col("b")) & limit_hit(F.col("p"), F.col("b"), ratio, True)).alias("limit_up"), F.count_if(live & (F.col("p") < F.col("b")) & limit_hit(F.col("p"), F.col("b"), ratio, False)).alias("limit_down"),
        (F.coalesce(F.sum("a"), F.lit(0.0)) / 1e8).alias("total_amount"),
    )


def top_bottom(sectors: DataFrame, n: int = 5) -> DataFrame:
    """sectors: name, change. side (top or bottom), rank, name, change; nulls left out, ties by name."""
    s = sectors.where("change is not null")
    top = s.orderBy(F.desc("change"), "name").limit(n).withColumn("side", F.lit("top"))
    bottom = s.orderBy("change", "name").limit(n).withColumn("side", F.lit("bottom"))
    key = F.when(F.col("side") == "top", -F.col("change")).otherwise(F.col("change"))
    return top.unionByName(bottom).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(key, "name"))).select("side", "rank", "name", "change")


def chip_metrics(chips: DataFrame, prices: DataFrame) -> DataFrame:
    """chips: code, price, percent. prices: code, close. Share of chips in profit, mean cost, and the price bands that hold
    90 and 70 percent of them with their concentration. A percentile is the first price whose running share reaches it."""
    total = F.sum("percent").over(Window.partitionBy("code"))
    w = Window.partitionBy("code").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    c = chips.join(prices, "code").withColumn("share", F.try_divide(F.col("percent") * 100, total))
    c = c.withColumn("cum", F.sum("share").over(w))
    at = lambda q: F.coalesce(F.min(F.when(F.col("cum") >= q, F.col("price"))), F.max("price"))
    g = c.groupBy("code").agg(
        (F.coalesce(F.sum(F.when(F.col("price") <= F.col("close"), F.col("share"))), F.lit(0.0)) / 100).alias("profit_ratio"),
        (F.sum(F.col("price") * F.col("share")) / F.sum("share")).alias("avg_cost"),
        at(5).alias("low90"), at(95).alias("high90"), at(15).alias("low70"), at(85).alias("high70"),
    )
    width = lambda k: F.coalesce(F.try_divide(F.col(f"high{k}") - F.col(f"low{k}"), F.col(f"high{k}") + F.col(f"low{k}")), F.lit(0.0))
    return g.withColumns({"concentration90": width(90), "concentration70": width(70)})


def dividend_ttm(dividends: DataFrame, as_of: Column) -> DataFrame:
    """dividends: code, ex_date, record_date, announce_date, per_share. Per code: events and cash per share of the last 365
    days, and the five latest event dates. Future events and repeats of (date, share to 6 digits) don't count."""
    d = dividends.withColumn("on", F.coalesce("ex_date", "record_date", "announce_date")).where((F.col("on") <= as_of) & (F.col("per_share") > 0))
    d = d.withColumn("k", F.round("per_share", 6)).dropDuplicates(["code", "on", "k"])
    recent = F.col("on") >= F.date_sub(as_of, 365)
    return d.groupBy("code").agg(F.count_if(recent).alias("ttm_events"), F.coalesce(F.sum(F.when(recent, F.col("k"))), F.lit(0.0)).alias("ttm_cash"), F.slice(F.sort_array(F.collect_set("on"), asc=False), 1, 5).alias("latest"))


def fundamental_status(blocks: DataFrame) -> DataFrame:
    """blocks: code, block, status. not_supported if all are; partial if any failed or is partial; else ok."""
    s = F.col("status")
    return blocks.groupBy("code").agg(F.when(F.bool_and(s == "not_supported"), "not_supported").when(F.bool_or(s.isin("failed", "partial")), "partial").otherwise("ok").alias("status"), F.count("*").alias("blocks"))


def event_flag(events: DataFrame, as_of: Column, days: int = 20) -> DataFrame:
    """events: code, on. recent_count: events in the window, or all of them if none is in it; flagged tells which."""
    inside = F.count_if(F.col("on").between(F.date_sub(as_of, days), as_of))
    return events.groupBy("code").agg((inside > 0).alias("flagged"), F.when(inside > 0, inside).otherwise(F.count("*")).alias("recent_count"), F.max("on").alias("latest"))
