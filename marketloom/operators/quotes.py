"""Quotes, names and blocks that come from several sources at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that a second source may fill, and words that stand for no name.
SUPPLEMENT = ("volume_ratio", "turnover_rate", "pe_ratio", "pb_ratio", "total_mv", "circ_mv", "amplitude")
NO_NAMES = ("N/A", "NA", "NONE", "NULL", "--", "-", "UNKNOWN", "TICKER")


def merged_quotes(quotes: DataFrame) -> DataFrame:
    """quotes: code, priority, source, price and SUPPLEMENT. The first source with a price; if it lacks a field, the next one
    with a price, and only that, fills what it can. One shuffle by code."""
    lacks = F.array_contains(F.array(*(F.col(f).isNull() for f in SUPPLEMENT)), True)
    sound = quotes.where("price > 0").withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("priority"))).where("_r <= 2")
    of = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    g = sound.groupBy("code").agg(
        of("source", 1).alias("source"), of("price", 1).alias("price"), F.bool_or(F.when(F.col("_r") == 1, lacks)).alias("lacks"), of("source", 2).alias("second"), *(F.struct(of(f, 1).alias("a"), of(f, 2).alias("b")).alias(f) for f in SUPPLEMENT)
    )
    return g.select("code", "source", "price", F.when(F.col("lacks"), F.col("second")).alias("supplement"), *(F.coalesce(f"{f}.a", f"{f}.b").alias(f) for f in SUPPLEMENT))


def first_source(rows: DataFrame, key: str = "kind") -> DataFrame:
    """rows: key, priority, source, ok and others. Rows of the first source that succeeded for each key, with `chain`: what
    was asked until then and how that ended."""
    best = rows.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("priority"))).alias("_best"), F.sort_array(F.collect_set(F.struct("priority", "source", "ok"))).alias("_chain"))
    asked = F.filter("_chain", lambda x: F.col("_best").isNull() | (x["priority"] <= F.col("_best")))
    best = best.select(key, "_best", F.transform(asked, lambda x: F.concat(x["source"], F.lit(":"), F.when(x["ok"], "ok").otherwise("failed"))).alias("chain"))
    return rows.join(best, key).where(F.col("priority") == F.col("_best")).drop("_best", "ok")


def meaningful(name: Column, code: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n != "") & (F.upper(n) != F.upper(F.trim(F.coalesce(code, F.lit(""))))) & ~n.startswith("股票") & ~F.upper(n).isin(*NO_NAMES)


def resolved_names(codes: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """codes: code. sources: code, name, in the order they are asked. The first name that means something, else a blank."""
    every = None
    for k, s in enumerate(sources):
        s = s.select("code", "name", F.lit(k).alias("_k"))
        every = s if every is None else every.unionByName(s)
    best = every.where(meaningful(F.col("name"), F.col("code"))).groupBy("code").agg(F.min_by("name", F.struct("_k", "name")).alias("name"))
    return codes.select("code").join(best, "code", "left").select("code", F.coalesce("name", F.lit("")).alias("name"))


def last_close_within(days_: DataFrame, closes: DataFrame, back: int = 7) -> DataFrame:
    """days_: pair, on. closes: pair, date, close. The last close that isn't null in [on - back, on], null if there is none."""
    from marketloom.operators.asof import asof

    df = asof(days_, closes.where("close is not null"), ["pair"], "on", "date", "_c")
    return df.withColumn("close", F.when(F.col("_c.date") >= F.date_sub("on", back), F.col("_c.close"))).drop("_c")


BLOCKS = ("valuation", "growth", "earnings", "institution", "capital_flow", "dragon_tiger", "boards")
_EMPTY = ("", "-", "nan", "none", "null", "n/a", "na")


def block_status(payload: Column, fallback: Column) -> Column:
    """ok if the payload says something; else the fallback, if that is a status of its own; else partial."""
    some = payload.isNotNull() & ~F.lower(F.trim(payload)).isin(*_EMPTY)
    return F.when(some, "ok").when(fallback.isin("failed", "partial", "not_supported"), fallback).otherwise("partial")


def fundamental_bundle(instruments: DataFrame, blocks: DataFrame) -> DataFrame:
    """instruments: code, is_etf. blocks: code, block, payload, fallback. A row for each instrument: the status of each block
    (absent: not_supported), all of them in one, and the payloads as a map. A fund is never ok."""
    b = blocks.withColumn("status", block_status(F.col("payload"), F.col("fallback")))
    each = b.groupBy("code").agg(*(F.max(F.when(F.col("block") == k, F.col("status"))).alias(k) for k in BLOCKS), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("status") == "ok", F.struct("block", "payload"))))).alias("data"))
    df = instruments.join(each, "code", "left").fillna("not_supported", list(BLOCKS))
    all_ = F.array(*BLOCKS)
    none = ~F.exists(all_, lambda x: x != "not_supported")
    status = F.when(none, "not_supported").when(F.col("is_etf") | F.exists(all_, lambda x: x.isin("failed", "partial")), "partial").otherwise("ok")
    return df.select("code", *BLOCKS, status.alias("status"), F.coalesce(F.map_keys("data"), F.array().cast("array<string>")).alias("with_data"))


def trending_mentions(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """lists: list, items (an array of structs with ticker, symbol, code and mentions; the first that is filled names it).
    codes: code. Each list's item of a code."""
    item = lists.select("list", F.posexplode("items").alias("pos", "x"))
    some = lambda c: F.nullif(F.trim(F.col(f"x.{c}")), F.lit(""))
    named = item.select("list", "pos", F.upper(F.coalesce(some("ticker"), some("symbol"), some("code"))).alias("code"), F.col("x.mentions").alias("mentions"))
    first = named.groupBy("list", "code").agg(F.min_by(F.struct("pos", "mentions"), "pos").alias("m"))
    return first.join(codes.select(F.upper("code").alias("code")).distinct(), "code").select("list", "code", "m.pos", "m.mentions")
