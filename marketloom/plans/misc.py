"""Queries on the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.functions.rounding import R, r
from marketloom.operators import logs, misc
from marketloom.plans.registry import query
from marketloom.sources.testdata import ANALYSES, INSTRUMENTS, analyses, instruments, table

_DETAILS = ("Read timed out", "未获取到数据", "HTTP 503: no data", "empty frame", "boom", "")


@query(f"""WITH e AS (SELECT s_suppkey, [{', '.join(f"'{d}'" for d in _DETAILS)}][CAST(s_suppkey % 6 AS INTEGER) + 1] AS detail FROM supplier)
SELECT s_suppkey, CASE WHEN NOT regexp_matches(lower(detail), 'timeout|timed out|connect failed|connection|ssl|proxy|network|503|502|429') AND regexp_matches(lower(detail), '未获取到|未找到|no data|not found|empty|查无') THEN 'empty_data' ELSE 'fetch_failed' END AS reason FROM e""")
def sync_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.element_at(F.array(*map(F.lit, _DETAILS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", misc.sync_error(detail).alias("reason"))


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS buy, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS sell, count(*) FILTER (WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')) AS hold, avg(o_orderkey % 100) AS avg_score FROM orders")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    decision = F.when(p == "2-HIGH", "buy").when(p == "5-LOW", "sell").when(p == "3-MEDIUM", "hold").when(p == "4-NOT SPECIFIED", " ").otherwise("other")
    return misc.report_counts(table(spark, sf_dir, "orders").select(decision.alias("decision"), (F.col("o_orderkey") % 100).alias("score")))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misc.task_stats(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query(f"WITH {ANALYSES} SELECT code, least(count(*), 150) AS n FROM analyses GROUP BY code")
def history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misc.history_count(analyses(spark, sf_dir), 150)


@query("""WITH b AS (SELECT p_partkey % 100 AS code, p_partkey AS ord, CASE WHEN p_size = 7 THEN '' ELSE p_brand END AS name, CASE WHEN p_size % 10 = 0 THEN '行业板块' ELSE p_type END AS type FROM part)
SELECT code, first(name ORDER BY type NOT LIKE '%行业%', ord) AS board FROM b WHERE name <> '' GROUP BY code""")
def primary_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 10 == 0, "行业板块").otherwise(F.col("p_type"))
    return misc.primary_board(table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("code"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") == 7, "").otherwise(F.col("p_brand")).alias("name"), kind.alias("type")))


@query("SELECT account, min(d) AS first FROM (SELECT o_custkey % 10 AS account, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT l_suppkey % 10, CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY account")
def first_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("account"), F.to_date("o_orderdate").alias("on"))
    b = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("account"), F.to_date("l_shipdate").alias("on"))
    return misc.first_activity([a, b])


@query(f"WITH {INSTRUMENTS}, n AS (SELECT CASE WHEN code::INTEGER % 9 = 0 THEN 'same' ELSE name END AS name, code FROM instruments), u AS (SELECT name, min(code) AS code FROM n GROUP BY name HAVING count(DISTINCT code) = 1) SELECT q.name, u.code FROM (SELECT DISTINCT name FROM n UNION ALL SELECT 'nobody') q LEFT JOIN u ON q.name = u.name")
def name_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = instruments(spark, sf_dir).select(F.when(F.col("code").cast("int") % 9 == 0, "same").otherwise(F.col("name")).alias("name"), "code")
    asked = n.select("name").distinct().unionByName(spark.sql("SELECT 'nobody' AS name"))
    return logs.exact_names(asked, n).select("name", "code")


@query("""SELECT event_id, CASE WHEN value / 40 < 0.5 THEN '极度萎缩' WHEN value / 40 < 0.8 THEN '明显萎缩' WHEN value / 40 < 1.2 THEN '正常' WHEN value / 40 < 2 THEN '温和放量' WHEN value / 40 < 3 THEN '明显放量' ELSE '巨量' END AS volume,
  CASE WHEN value >= 80 THEN '极度乐观' WHEN value >= 60 THEN '乐观' WHEN value >= 40 THEN '中性' WHEN value >= 20 THEN '悲观' ELSE '极度悲观' END AS sentiment FROM events""")
def labels_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.volume_bucket(F.col("value") / 40).alias("volume"), text.sentiment(F.col("value")).alias("sentiment"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id % 20 AS account, CAST(ts AS DATE) AS "on", CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS priority, event_id AS id, event_id % 5 AS k, floor(value) + 1 AS quantity FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY "on", priority, id) AS n FROM e), f AS (
  SELECT DISTINCT account, 0::BIGINT AS n, 0.0::DOUBLE AS q, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS cash FROM e
  UNION ALL SELECT f.account, s.n, CASE k WHEN 1 THEN q WHEN 2 THEN q * 1.001 WHEN 0 THEN q ELSE q + quantity END, CASE WHEN k >= 3 THEN cost + quantity * 2 + 0.5 ELSE cost END,
    CASE k WHEN 0 THEN cash + quantity WHEN 1 THEN cash + q * 0.01 WHEN 2 THEN cash ELSE cash - quantity * 2 - 0.5 END FROM f JOIN s ON f.account = s.account AND s.n = f.n + 1
), z AS (SELECT account, q AS quantity, cost, cash FROM f QUALIFY row_number() OVER (PARTITION BY account ORDER BY n DESC) = 1) SELECT account, {R('quantity', 'cost', 'cash', digits=2)} FROM z""")
def portfolio_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("account"), F.to_date("ts").alias("on"), F.col("event_id").alias("id"), F.when(k == 0, "deposit").when(k == 1, "dividend").when(k == 2, "split").otherwise("buy").alias("kind"),
        (F.floor("value") + 1).cast("double").alias("quantity"), F.when(k == 1, 0.01).otherwise(2.0).alias("price"), F.lit(0.5).alias("charges"), F.lit(1.001).alias("ratio"))
    parts = [e.where(F.col("kind") == "deposit"), e.where(F.col("kind").isin("dividend", "split")), e.where(F.col("kind") == "buy")]
    return misc.replay(misc.ledger(*parts), ["account"]).select("account", *r("quantity", "cost", "cash", digits=2))


@query(f"""WITH {INSTRUMENTS}, c AS (SELECT r_name AS market, DATE '2000-01-01' + CAST(r_regionkey * 10 + k AS INTEGER) AS "on", (r_regionkey + k) % 3 <> 0 AS open FROM region, (SELECT unnest(range(10)) AS k))
SELECT i.code, i.market FROM instruments i LEFT JOIN c ON c.market = i.market AND c."on" = DATE '2000-01-12' WHERE coalesce(c.open, true)""")
def trading_day_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misc.open_markets(instruments(spark, sf_dir).select("code", "market"), _calendar(spark, sf_dir), F.lit("2000-01-12").cast("date")).select("code", "market")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    c = table(spark, sf_dir, "region").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return c.select(F.col("r_name").alias("market"), F.date_add(F.lit("2000-01-01").cast("date"), k * 10 + F.col("k")).alias("on"), ((k + F.col("k")) % 3 != 0).alias("open"))


@query("""WITH c AS (SELECT r_name AS market, DATE '2000-01-01' + CAST(r_regionkey * 10 + k AS INTEGER) AS "on", (r_regionkey + k) % 3 <> 0 AS open FROM region, (SELECT unnest(range(10)) AS k)) SELECT market, max("on") AS "on" FROM c WHERE open AND "on" <= DATE '2000-01-25' GROUP BY market""")
def effective_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misc.effective_day(_calendar(spark, sf_dir), F.lit("2000-01-25").cast("date"))


@query(f"WITH {INSTRUMENTS}, q AS (SELECT lpad(CAST(p_partkey % 150 AS VARCHAR), 6, '0') AS code FROM part) SELECT code, industry FROM instruments UNION ALL SELECT DISTINCT code, NULL FROM q WHERE code NOT IN (SELECT code FROM instruments)")
def universe_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") % 150).cast("string"), 6, "0").alias("code"))
    return misc.missing_codes(asked, instruments(spark, sf_dir)).select("code", "industry")
