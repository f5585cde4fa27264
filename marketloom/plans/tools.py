"""Named tools over DataFrames, with typed parameters, and rules that users write as expressions."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, NamedTuple, get_type_hints

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import backtest, history, indicators, market, quotes, search
from marketloom.sources.bars import date_range

_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class Tool(NamedTuple):
    name: str
    run: Callable[..., DataFrame]
    about: str
    parameters: dict[str, Any]  # JSON schema; tables aren't part of it


TOOLS: dict[str, Tool] = {}


def tool(name: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function. Its tables come first; its other parameters, from their annotations, are the tool's."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        hints = get_type_hints(f)
        props, needed = {}, []
        for p in inspect.signature(f).parameters.values():
            if hints.get(p.name) is DataFrame:
                continue
            props[p.name] = {"type": _KINDS.get(hints.get(p.name), "string")}
            if p.default is inspect.Parameter.empty:
                needed.append(p.name)
            else:
                props[p.name]["default"] = p.default
        TOOLS[name or f.__name__] = Tool(name or f.__name__, f, inspect.getdoc(f) or "", {"type": "object", "properties": props, "required": needed})
        return f

    return add


def execute(name: str, *tables: DataFrame, **arguments: Any) -> DataFrame:
    """Runs a tool; unknown, missing or wrongly typed arguments are errors."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}")
    schema = TOOLS[name].parameters
    kinds = {v: k for k, v in _KINDS.items()}
    for key, value in arguments.items():
        if key not in schema["properties"]:
            raise TypeError(f"{name} has no parameter {key!r}")
        kind = kinds[schema["properties"][key]["type"]]
        if not isinstance(value, (int, float) if kind is float else kind) or (kind is not bool and isinstance(value, bool)):
            raise TypeError(f"{key} of {name} must be {kind.__name__}")
    if missing := [k for k in schema["required"] if k not in arguments]:
        raise TypeError(f"{name} needs {', '.join(missing)}")
    return TOOLS[name].run(*tables, **arguments)


@tool()
def get_daily_history(bars: DataFrame, code: str, end: str, days: int = 30) -> DataFrame:
    """The last bars of a code."""
    return date_range(bars, code, end=end, days=days).orderBy(F.desc("date")).limit(days)


@tool()
def get_realtime_quote(quotes_: DataFrame, code: str) -> DataFrame:
    """The quote of a code, from its sources."""
    return quotes.merged_quotes(quotes_.where(F.col("code") == code))


@tool()
def get_chip_distribution(chips: DataFrame, prices: DataFrame, code: str) -> DataFrame:
    """How the chips of a code are spread over prices."""
    return market.chip_metrics(chips.where(F.col("code") == code), prices)


@tool()
def get_stock_info(instruments: DataFrame, blocks: DataFrame, code: str) -> DataFrame:
    """Fundamental blocks of a code."""
    return quotes.fundamental_bundle(instruments.where(F.col("code") == code), blocks)


@tool()
def get_analysis_context(bars: DataFrame, code: str) -> DataFrame:
    """The last bar of a code against the one before."""
    return history.bar_context(indicators.lenient_averages(bars.where(F.col("code") == code)))


@tool()
def get_recent_signals(rows: DataFrame, now: str, code: str, limit: int = 5) -> DataFrame:
    """What was advised for a code lately."""
    return history.recent_signals(rows.where(F.col("code") == code), F.lit(now).cast("timestamp"), most=limit)


@tool()
def analyze_trend(bars: DataFrame, code: str) -> DataFrame:
    """Trend, signal and reasons of a code's last bar."""
    return indicators.latest(indicators.trend_signal(bars.where(F.col("code") == code)))


@tool()
def calculate_ma(bars: DataFrame, code: str) -> DataFrame:
    """Averages of a code's closes."""
    return indicators.calculate_ma(bars.where(F.col("code") == code))


@tool()
def get_volume_analysis(bars: DataFrame, code: str, days: int = 30) -> DataFrame:
    """Volume and price of a code."""
    return indicators.volume_analysis(bars.where(F.col("code") == code), days)


@tool()
def analyze_pattern(bars: DataFrame, code: str, days: int = 60) -> DataFrame:
    """Shapes of a code's last bars."""
    return indicators.candle_patterns(bars.where(F.col("code") == code), days)


@tool()
def get_market_indices(rows: DataFrame) -> DataFrame:
    """Indices of the first source that has them."""
    return quotes.first_source(rows)


@tool()
def get_sector_rankings(sectors: DataFrame, n: int = 5) -> DataFrame:
    """Sectors that rose and fell most."""
    return market.top_bottom(sectors, n)


@tool()
def search_stock_news(items: DataFrame, today: str, days: int = 3, limit: int = 5) -> DataFrame:
    """News of the first provider that has fresh ones."""
    return search.failover_after_filter(items, F.lit(today).cast("date"), days, limit)


@tool()
def search_comprehensive(items: DataFrame, attempts: int = 3, limit: int = 5) -> DataFrame:
    """News of several questions, each url once."""
    return search.enhanced(items, attempts, limit)


@tool()
def get_stock_backtest_summary(results: DataFrame, code: str) -> DataFrame:
    """How past advice on a code went."""
    return backtest.summary(results).where(F.col("code") == code)


@tool()
def get_strategy_backtest_summary(results: DataFrame) -> DataFrame:
    """How past advice went, by advice."""
    return backtest.advice_breakdown(results)


def matching_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rows with `rules`: names of the rules (SQL conditions over the columns) that hold, in their order."""
    return rows.withColumn("rules", F.filter(F.array(*(F.when(F.expr(when), F.lit(name)) for name, when in rules.items())), lambda x: x.isNotNull()))
