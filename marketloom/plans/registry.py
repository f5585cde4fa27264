"""The registered queries, by name, and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("indicators", "screening", "backtest", "portfolio", "market", "logs", "text", "writes", "streams", "misc", "ledger", "quotes", "search", "history", "payloads", "strategies", "sources")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"marketloom.plans.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
