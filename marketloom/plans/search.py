"""Queries on news of several providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import logs, search
from marketloom.plans.registry import query
from marketloom.sources.testdata import table

ITEMS = """items AS (SELECT event_id AS ord, user_id % 40 AS request, (event_id // 7) % 4 AS provider, event_id % 5 AS template, 'u' || (event_id % 31) AS url, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS published FROM events)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("ord"), (F.col("user_id") % 40).alias("request"), (F.floor(k / 7) % 4).alias("provider"), (k % 5).alias("template"), F.concat(F.lit("u"), (k % 31).cast("string")).alias("url"), F.when(k % 9 == 0, None).otherwise(F.to_date("ts")).alias("published"))


@query(f"""WITH {ITEMS}, f AS (SELECT * FROM items WHERE published BETWEEN DATE '2024-01-15' - 2 AND DATE '2024-01-15' + 1 AND (provider <> 0 OR request % 3 = 0)), p AS (SELECT *, min(provider) OVER (PARTITION BY request) AS p FROM f),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY ord) AS INTEGER) AS rank FROM p WHERE provider = p) SELECT request, provider, ord, rank FROM r WHERE rank <= 5""")
def news_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).where("provider <> 0 or request % 3 = 0")
    return search.failover_after_filter(items, F.lit("2024-01-15").cast("date"), 3, 5).select("request", "provider", "ord", "rank")


@query(f"WITH {ITEMS} SELECT request, ord, CAST((row_number() OVER (PARTITION BY request ORDER BY ord) - 1) % 3 AS INTEGER) AS provider FROM items")
def search_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.round_robin(_items(spark, sf_dir).select("request", F.col("ord").alias("dimension")), 3).select("request", F.col("dimension").alias("ord"), "provider")


@query(f"""WITH {ITEMS}, a AS (SELECT *, min(provider) OVER (PARTITION BY request, template) AS p FROM items WHERE template < 3), b AS (SELECT *, row_number() OVER (PARTITION BY request, template ORDER BY ord) AS r FROM a WHERE provider = p),
  c AS (SELECT *, row_number() OVER (PARTITION BY request, url ORDER BY template, ord) AS u FROM b WHERE r <= 3), d AS (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY template, ord) AS INTEGER) AS rank FROM c WHERE u = 1) SELECT request, template, ord, url, rank FROM d WHERE rank <= 6""")
def search_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.enhanced(_items(spark, sf_dir), 3, 6).select("request", "template", "ord", "url", "rank")


@query("""WITH n AS (SELECT event_id AS id, user_id % 40 AS code, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts - to_hours(CAST(event_id % 50 AS INTEGER)) END AS published, ts AS fetched FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY coalesce(published, fetched) DESC, fetched DESC, id DESC) AS INTEGER) AS rank FROM n) SELECT id, code, rank FROM r WHERE rank <= 4""")
def news_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    n = table(spark, sf_dir, "events").select(k.alias("id"), (F.col("user_id") % 40).alias("code"), F.when(k % 4 == 0, None).otherwise(ts - F.make_dt_interval(hours=(k % 50).cast("int"))).alias("published"), ts.alias("fetched"))
    return search.recent(n, F.lit("2024-01-20 12:00:00").cast("timestamp"), 7, 4).select("id", "code", "rank")


@query("""WITH a AS (SELECT event_id AS id, user_id % 50 AS code, CASE WHEN event_id % 4 = 0 THEN event_id END AS query_id, ts AS created_at FROM events WHERE event_id % 5 = 0),
  n AS (SELECT event_id AS news_id, user_id % 50 AS code, CASE WHEN event_id % 2 = 1 THEN event_id - 1 END AS query_id, ts AS fetched_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) - CAST(event_id % 6 AS INTEGER) END AS published FROM events WHERE event_id % 5 <> 0),
  d AS (SELECT a.id, n.news_id FROM a JOIN n ON a.query_id = n.query_id)
SELECT a.id, n.news_id FROM a JOIN n ON a.code = n.code AND abs(floor(epoch(a.created_at)) - floor(epoch(n.fetched_at))) <= 21600 WHERE a.id NOT IN (SELECT id FROM d) AND n.published BETWEEN CAST(a.created_at AS DATE) - 2 AND CAST(a.created_at AS DATE) + 1""")
def news_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of analyses that have none by query id: near in time, and published near the analysis."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    a = e.where("event_id % 5 = 0").select(k.alias("id"), (F.col("user_id") % 50).alias("code"), F.when(k % 4 == 0, k).alias("query_id"), F.col("ts").alias("created_at"))
    n = e.where("event_id % 5 <> 0").select(k.alias("news_id"), (F.col("user_id") % 50).alias("code"), F.when(k % 2 == 1, k - 1).alias("query_id"), F.col("ts").alias("fetched_at"), F.when(k % 7 == 0, None).otherwise(F.date_sub(F.to_date("ts"), (k % 6).cast("int"))).alias("published"))
    direct = a.join(n.select("query_id"), "query_id", "left_semi").select("id")
    rest = a.join(direct, "id", "left_anti").drop("query_id").withColumn("anchor", F.to_date("created_at"))
    return search.published_around(logs.news_near(rest, n.drop("query_id")), 3).select("id", "news_id")
