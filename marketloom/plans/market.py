"""Queries on the market as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.operators import market as m
from marketloom.plans.registry import query
from marketloom.sources.testdata import BARS, INSTRUMENTS, bars, instruments, table

W = "PARTITION BY code ORDER BY date"
QUOTES = f"""{BARS}, {INSTRUMENTS}, lastb AS (SELECT code, date, close, lag(close) OVER ({W}) AS prev, amount FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
  quotes AS (SELECT CASE CAST(b.code AS INTEGER) % 4 WHEN 0 THEN '60' || substr(b.code, 3) WHEN 1 THEN '30' || substr(b.code, 3) WHEN 2 THEN '83' || substr(b.code, 3) ELSE '00' || substr(b.code, 3) END AS code, CASE WHEN is_st THEN 'ST' || name ELSE name END AS name,
    floor(CASE WHEN CAST(b.code AS INTEGER) % 5 = 0 THEN prev * 1.1 WHEN CAST(b.code AS INTEGER) % 5 = 1 THEN prev * 0.8 WHEN CAST(b.code AS INTEGER) % 5 = 2 THEN prev ELSE close END * 100 + 0.5) / 100 AS last, prev AS prev_close, amount, industry FROM lastb b JOIN instruments i ON b.code = i.code)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bars as quotes, with boards and moves dealt by code so that every limit occurs."""
    w = Window.partitionBy("code").orderBy("date")
    b = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(w)).withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("_r = 1")
    b = b.join(instruments(spark, sf_dir), "code")
    k, tail = F.col("code").cast("int"), F.substring("code", 3, 10)
    code = F.concat(F.when(k % 4 == 0, "60").when(k % 4 == 1, "30").when(k % 4 == 2, "83").otherwise("00"), tail)
    price = F.when(k % 5 == 0, F.col("prev") * 1.1).when(k % 5 == 1, F.col("prev") * 0.8).when(k % 5 == 2, F.col("prev")).otherwise(F.col("close"))
    return b.select(code.alias("code"), F.when(F.col("is_st"), F.concat(F.lit("ST"), "name")).otherwise(F.col("name")).alias("name"), (F.floor(price * 100 + 0.5) / 100).alias("last"), F.col("prev").alias("prev_close"), "amount", "industry")


_RATIO = "CASE WHEN regexp_matches(code, '^(43|83|87|88|92)[0-9]{4}$') THEN 0.30 WHEN regexp_matches(code, '^(688|30)') THEN 0.20 WHEN contains(upper(name), 'ST') THEN 0.05 ELSE 0.10 END::DOUBLE"
_HIT = "abs(last - floor({0} * 100 + 0.5) / 100) <= floor(abs({0} - floor({0} * 100 + 0.5) / 100) * 1e10 + 0.5) / 1e10"


@query(f"""WITH {QUOTES}, q AS (SELECT *, {_RATIO} AS ratio FROM quotes), t AS (SELECT count(*) FILTER (WHERE last > prev_close) AS up, count(*) FILTER (WHERE last < prev_close) AS down, count(*) FILTER (WHERE last = prev_close) AS flat,
  count(*) FILTER (WHERE last > prev_close AND {_HIT.format('(prev_close * (1 + ratio))')}) AS limit_up, count(*) FILTER (WHERE last < prev_close AND {_HIT.format('(prev_close * (1 - ratio))')}) AS limit_down, sum(amount) / 1e8 AS total_amount FROM q)
SELECT up, down, flat, limit_up, limit_down, {R('total_amount', digits=6)} FROM t""")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.breadth(quotes(spark, sf_dir)).select("up", "down", "flat", "limit_up", "limit_down", *r("total_amount", digits=6))


@query(f"""WITH {QUOTES}, s AS (SELECT industry AS name, avg((last / prev_close - 1) * 100) AS change FROM quotes GROUP BY industry), t AS (
  SELECT 'top' AS side, row_number() OVER (ORDER BY change DESC, name) AS rank, * FROM s QUALIFY rank <= 5 UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY change, name) AS rank, * FROM s QUALIFY rank <= 5)
SELECT side, CAST(rank AS INTEGER) AS rank, name, {R('change')} FROM t""")
def sector_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quotes(spark, sf_dir).groupBy(F.col("industry").alias("name")).agg(F.avg((F.col("last") / F.col("prev_close") - 1) * 100).alias("change"))
    return m.top_bottom(s).select("side", "rank", "name", *r("change"))


CHIPS = f"""{BARS}, chips AS (SELECT code, floor(close / 100) * 100 AS price, sum(volume) AS percent FROM bars GROUP BY 1, 2), prices AS (SELECT code, arg_max(close, date) AS close FROM bars GROUP BY code)"""


@query(f"""WITH {CHIPS}, s AS (SELECT c.code, price, close, percent * 100 / sum(percent) OVER (PARTITION BY c.code) AS share FROM chips c JOIN prices p ON c.code = p.code), k AS (SELECT *, sum(share) OVER (PARTITION BY code ORDER BY price ROWS UNBOUNDED PRECEDING) AS cum FROM s),
  g AS (SELECT code, coalesce(sum(share) FILTER (WHERE price <= close), 0.0) / 100 AS profit_ratio, sum(price * share) / sum(share) AS avg_cost, coalesce(min(price) FILTER (WHERE cum >= 5), max(price)) AS low90, coalesce(min(price) FILTER (WHERE cum >= 95), max(price)) AS high90,
    coalesce(min(price) FILTER (WHERE cum >= 15), max(price)) AS low70, coalesce(min(price) FILTER (WHERE cum >= 85), max(price)) AS high70 FROM k GROUP BY code), h AS (SELECT *, coalesce((high90 - low90) / nullif(high90 + low90, 0), 0.0) AS concentration90, coalesce((high70 - low70) / nullif(high70 + low70, 0), 0.0) AS concentration70 FROM g)
SELECT code, low90, high90, low70, high70, {R('profit_ratio', 'avg_cost', 'concentration90', 'concentration70')} FROM h""")
def chip_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    chips = b.groupBy("code", (F.floor(F.col("close") / 100) * 100).cast("double").alias("price")).agg(F.sum("volume").alias("percent"))
    return m.chip_metrics(chips, b.groupBy("code").agg(F.max_by("close", "date").alias("close"))).select("code", "low90", "high90", "low70", "high70", *r("profit_ratio", "avg_cost", "concentration90", "concentration70"))


DIV = """dv AS (SELECT lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS code, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ex_date, CAST(o_orderdate AS DATE) + 2 AS record_date, CAST(o_orderkey % 7 AS DOUBLE) / 8 AS per_share FROM orders)"""


@query(f"""WITH {DIV}, e AS (SELECT DISTINCT code, coalesce(ex_date, record_date) AS on_, round(per_share, 6) AS k FROM dv WHERE per_share > 0 AND coalesce(ex_date, record_date) <= DATE '2000-12-31')
SELECT code, count(*) FILTER (WHERE on_ >= DATE '2000-12-31' - 365) AS ttm_events, coalesce(sum(k) FILTER (WHERE on_ >= DATE '2000-12-31' - 365), 0.0) AS ttm_cash, array_to_string(list_sort(list_distinct(list(on_)), 'DESC')[1:5], ',') AS latest FROM e GROUP BY code""")
def dividend_ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    o, on = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    d = o.select(F.lpad((F.col("o_custkey") % n).cast("string"), 6, "0").alias("code"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(on).alias("ex_date"), F.date_add(on, 2).alias("record_date"), F.lit(None).cast("date").alias("announce_date"), ((F.col("o_orderkey") % 7).cast("double") / 8).alias("per_share"))
    return m.dividend_ttm(d, F.lit("2000-12-31").cast("date")).select("code", "ttm_events", "ttm_cash", F.concat_ws(",", F.transform("latest", lambda x: x.cast("string"))).alias("latest"))


@query("""SELECT lpad(CAST(p_partkey % 50 AS VARCHAR), 6, '0') AS code, CASE WHEN bool_and(p_size % 4 = 0) THEN 'not_supported' WHEN bool_or(p_size % 4 = 1 AND p_size > 40) THEN 'partial' ELSE 'ok' END AS status, count(*) AS blocks FROM part GROUP BY 1""")
def fundamental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("p_size") % 4 == 0, "not_supported").when((F.col("p_size") % 4 == 1) & (F.col("p_size") > 40), "failed").otherwise("ok")
    return m.fundamental_status(table(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") % 50).cast("string"), 6, "0").alias("code"), F.col("p_name").alias("block"), s.alias("status")))


@query("""SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code, count(*) FILTER (WHERE o_orderdate::DATE BETWEEN DATE '2001-06-10' AND DATE '2001-06-30') > 0 AS flagged,
  CASE WHEN count(*) FILTER (WHERE o_orderdate::DATE BETWEEN DATE '2001-06-10' AND DATE '2001-06-30') > 0 THEN count(*) FILTER (WHERE o_orderdate::DATE BETWEEN DATE '2001-06-10' AND DATE '2001-06-30') ELSE count(*) END AS recent_count, max(o_orderdate::DATE) AS latest FROM orders GROUP BY 1""")
def event_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.lpad((F.col("o_custkey") % 100).cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("on"))
    return m.event_flag(e, F.lit("2001-06-30").cast("date"))
