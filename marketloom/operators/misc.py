"""Smaller inventory operators: sync errors, presets, reports, tasks, boards, first activity, regime routing, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.portfolio import by_average

# Fixed markers of error texts.
BLOCKING = ("timeout", "timed out", "connect failed", "connection", "ssl", "proxy", "network", "503", "502", "429")
EMPTY = ("未获取到", "未找到", "no data", "not found", "empty", "查无")
DELISTED = ("退市", "delisted", "终止上市")


def sync_error(detail: Column) -> Column:
    """empty_data or fetch_failed: a marker of a blocked connection outweighs one of missing data."""
    low = F.lower(F.trim(F.coalesce(detail, F.lit(""))))
    has = lambda words: F.array_contains(F.array(*(low.contains(w) for w in words)), True)
    return F.when(~has(BLOCKING) & has(EMPTY), "empty_data").otherwise("fetch_failed")


def sync_gate(errors: DataFrame, expected: int, most: float = 0.02) -> DataFrame:
    """errors: code, detail, name. One row: errors that may be skipped (no data, or delisted by name), blocking ones, and
    whether the blocking ones are too many."""
    gone = F.array_contains(F.array(*(F.coalesce(F.lower("name"), F.lit("")).contains(w) for w in DELISTED)), True)
    skippable = gone | (sync_error(F.col("detail")) == "empty_data")
    g = errors.agg(F.count_if(skippable).alias("skippable"), F.count_if(~skippable).alias("blocking"))
    return g.withColumn("failed", F.coalesce(F.try_divide(F.col("blocking"), F.lit(expected)), F.lit(0.0)) > most)


#: What a mode of screening asks for; it may only loosen (aggressive) or tighten (quality) the base settings.
HIGHER = {"candidate_limit", "ai_top_k"}


def resolve_mode(mode: str, base: dict[str, float], preset: dict[str, float]) -> dict[str, float]:
    """Settings of a screening run: for each key the looser or stricter of preset and base."""
    pick = {"aggressive": (max, min), "quality": (min, max)}.get(mode)
    if pick is None:
        return dict(base)
    return {k: (pick[0] if k in HIGHER else pick[1])(v, preset[k]) if k in preset else v for k, v in base.items()}


def report_counts(results: DataFrame) -> DataFrame:
    """results: decision, score. One row of counts; a blank decision is a hold."""
    d = F.trim(F.coalesce("decision", F.lit("")))
    return results.agg(F.count_if(d == "buy").alias("buy"), F.count_if(d == "sell").alias("sell"), F.count_if(d.isin("hold", "")).alias("hold"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def history_count(rows: DataFrame, most: int = 1000) -> DataFrame:
    return rows.groupBy("code").agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def primary_board(boards: DataFrame) -> DataFrame:
    """boards: code, ord, name, type. The first of an industry type, else the first with a name."""
    named = boards.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    industry = F.lower(F.coalesce("type", F.lit(""))).rlike("行业|industry")
    return named.groupBy("code").agg(F.min_by("name", F.struct((~industry).alias("other"), "ord")).alias("board"))


#: Keys under which sources give a board's name, code and kind.
BOARD_KEYS = {"name": ("板块名称", "板块", "所属板块", "板块名", "name", "industry"), "code": ("板块代码", "代码", "code"), "type": ("板块类型", "类别", "type")}


def normalized_boards(rows: DataFrame) -> DataFrame:
    """rows: code, items (an array of maps of text). code, ord, name, board, type of each board with a name, its first place
    only; names are trimmed."""
    pick = lambda keys: F.coalesce(*(F.when(~F.lower(F.trim(F.element_at("x", F.lit(k)))).isin("", "nan", "none", "-"), F.trim(F.element_at("x", F.lit(k)))) for k in keys))
    each = rows.select("code", F.posexplode("items").alias("ord", "x")).select("code", "ord", *(pick(keys).alias(to) for to, keys in (("name", BOARD_KEYS["name"]), ("board", BOARD_KEYS["code"]), ("type", BOARD_KEYS["type"]))))
    return each.where("name is not null").groupBy("code", "name").agg(F.min_by(F.struct("ord", "board", "type"), "ord").alias("b")).select("code", "b.ord", "name", "b.board", "b.type")


def with_boards(symbols: DataFrame, boards: DataFrame) -> DataFrame:
    """symbols: code. Its primary board, UNCLASSIFIED without one."""
    return symbols.join(primary_board(boards), "code", "left").select("code", F.coalesce("board", F.lit("UNCLASSIFIED")).alias("board"))


def first_activity(ledgers: Sequence[DataFrame]) -> DataFrame:
    """ledgers: account, on. The first day of each account over all of them."""
    every = ledgers[0]
    for x in ledgers[1:]:
        every = every.unionByName(x)
    return every.groupBy("account").agg(F.min("on").alias("first"))


def ledger(cash: DataFrame, actions: DataFrame, trades: DataFrame) -> DataFrame:
    """One order of events: by day, then cash, corporate actions, trades, then id."""
    parts = [df.withColumn("priority", F.lit(k)) for k, df in enumerate((cash, actions, trades))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def replay(events: DataFrame, keys: Sequence[str] = ("account", "symbol")) -> DataFrame:
    """events: keys, on, priority, id, kind (buy, sell, dividend, split, deposit, withdrawal), quantity, price, charges, ratio.
    Quantity, cost (average), cash and profit after all of a ledger's events, by scans (see portfolio.by_average). A dividend pays what
    is held then; a split changes quantity, not cost."""
    rows = by_average(events, keys, ("on", "priority", "id"))
    gross, charges = F.col("quantity") * F.col("price"), F.coalesce("charges", F.lit(0.0))
    kind = lambda k: F.col("kind") == k
    cash = F.when(kind("buy"), -gross - charges).when(kind("sell"), gross - charges).when(kind("dividend"), F.col("held_before") * F.col("price")).when(kind("deposit"), F.col("quantity")).when(kind("withdrawal"), -F.col("quantity"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    end = F.max_by(F.struct("held", "cost"), "n").alias("z")
    df = rows.groupBy(*keys).agg(end, total(cash).alias("cash"), total(F.when(kind("sell"), gross - charges - F.col("part"))).alias("realized_pnl"))
    return df.select(*keys, F.col("z.held").alias("quantity"), F.col("z.cost").alias("cost"), "cash", "realized_pnl")


def open_markets(symbols: DataFrame, calendar: DataFrame, day: Column) -> DataFrame:
    """symbols: code, market. calendar: market, on, open. Symbols whose market trades on the day; a market or day that the
    calendar doesn't know passes."""
    there = calendar.where(F.col("on") == day).select("market", "open")
    return symbols.join(there, "market", "left").where(F.coalesce("open", F.lit(True))).drop("open")


def effective_day(calendar: DataFrame, day: Column) -> DataFrame:
    """market, on: the last open day of each market that isn't after the day."""
    return calendar.where(F.col("open") & (F.col("on") <= day)).groupBy("market").agg(F.max("on").alias("on"))


def missing_codes(requested: DataFrame, known: DataFrame) -> DataFrame:
    """known instruments, and a bare row for each requested code that isn't among them."""
    absent = requested.select("code").distinct().join(known.select("code"), "code", "left_anti")
    return known.unionByName(absent, allowMissingColumns=True)
