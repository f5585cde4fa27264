"""The domain tables, from the driver's TPC-H-like ones. Each function has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, period: str = "day") -> DataFrame:
    """Bars of each supplier by day, or by month under its first day: price is extended price over quantity, first and last by a
    total order of lines."""
    day = F.to_date("l_shipdate") if period == "day" else F.trunc("l_shipdate", period)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", day.alias("date"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    grouped = line.groupBy(F.col("l_suppkey").alias("_s"), "date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )
    return grouped.select(F.lpad(F.col("_s").cast("string"), 6, "0").alias("code"), "date", "open", "high", "low", "close", "volume", "amount")


BARS = """bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS date,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""

MONTHLY_BARS = BARS.replace("CAST(l_shipdate AS DATE)", "CAST(date_trunc('month', l_shipdate) AS DATE)")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instruments: industry is the nation, market the region; list date is the first bar."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("list_date"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(first, s.s_suppkey == first.l_suppkey, "left")
    return joined.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("market"), "list_date", (F.col("s_suppkey") % 10 == 3).alias("is_st"))


INSTRUMENTS = """instruments AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, n_name AS industry, r_name AS market,
         (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem WHERE l_suppkey = s_suppkey) AS list_date, s_suppkey % 10 = 3 AS is_st
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as past recommendations: five priorities give five pieces of advice."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))  # one row
    advice = F.create_map(*(F.lit(x) for x in ("1-URGENT", "强烈买入", "2-HIGH", "buy", "3-MEDIUM", "hold", "4-NOT SPECIFIED", "观望", "5-LOW", "sell")))
    return o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("id"), F.lpad((F.col("o_custkey") % F.col("n")).cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("date"), F.element_at(advice, F.col("o_orderpriority")).alias("advice"))


ANALYSES = """analyses AS (
  SELECT o_orderkey AS id, lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS date,
         CASE o_orderpriority WHEN '1-URGENT' THEN '强烈买入' WHEN '2-HIGH' THEN 'buy' WHEN '3-MEDIUM' THEN 'hold' WHEN '4-NOT SPECIFIED' THEN '观望' WHEN '5-LOW' THEN 'sell' END AS advice
  FROM orders
)"""
