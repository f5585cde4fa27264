"""Queries that run streams over the events table until all of it is read, and the batch SQL that gives the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.plans.registry import query
from marketloom.sources import versions, writes
from marketloom.sources.testdata import BARS, bars, table
from marketloom.streaming import streams


def _checkpoint(spark: SparkSession) -> str:
    return writes.scratch(spark, "streams")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.dedup(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days")
    return streams.drained(f"d{uuid.uuid4().hex}", s.select("user_id", "event_type", F.lit(True).alias("seen")), _checkpoint(spark))


@query(f"WITH g AS (SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) SELECT begins, event_type, n, {R('total', digits=3)} FROM g")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.windowed(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], "60 days")
    return streams.drained(f"w{uuid.uuid4().hex}", s.select(F.col("w.start").alias("begins"), "event_type", "n", "total"), _checkpoint(spark), "complete").select("begins", "event_type", "n", *r("total", digits=3))


@query("""WITH RECURSIVE e AS (SELECT 's' || (user_id % 7) AS source, ts, value < 50 AS ok, CAST(floor(epoch(ts)) AS BIGINT) AS at, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, value >= 50) AS n FROM events),
  f AS (SELECT source, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 0 AS count, 0::BIGINT AS opened, NULL::VARCHAR AS state FROM (SELECT DISTINCT source FROM e)
    UNION ALL SELECT e.source, e.n, e.ts, CASE WHEN f.opened > 0 AND e.at - f.opened < 300 THEN f.count WHEN e.ok THEN 0 ELSE f.count + 1 END,
      CASE WHEN f.opened > 0 AND e.at - f.opened < 300 THEN f.opened WHEN e.ok THEN 0 WHEN f.opened > 0 OR f.count + 1 >= 3 THEN e.at ELSE 0 END,
      CASE WHEN f.opened > 0 AND e.at - f.opened < 300 THEN NULL WHEN e.ok THEN CASE WHEN f.opened > 0 THEN 'closed' END WHEN f.opened > 0 OR f.count + 1 >= 3 THEN 'open' END
    FROM f JOIN e ON e.source = f.source AND e.n = f.n + 1)
SELECT source, CAST(ts AS TIMESTAMP) AS ts, state FROM f WHERE state IS NOT NULL""")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event is read again as a call of another source a year later, which moves the watermark past all others."""
    e = _events(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max_by("event_id", F.struct("ts", "event_id"))).first()[0]
    tick = (F.col("event_id") == last) & (F.col("k") == 1)
    e = e.withColumn("k", F.explode(F.when(F.col("event_id") == last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ts = F.when(tick, F.col("ts") + F.expr("INTERVAL 366 DAYS")).otherwise(F.col("ts"))
    e = e.select(F.when(tick, "tick").otherwise(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))).alias("source"), ts.alias("ts"), (F.col("value") < 50).alias("ok"))
    return streams.drained(f"b{uuid.uuid4().hex}", streams.breaker(e), _checkpoint(spark)).where("source <> 'tick'")


@query("""WITH a AS (SELECT event_id AS id, user_id % 50 AS code, ts AS created_at FROM events WHERE event_id % 5 = 0),
  n AS (SELECT event_id AS news_id, user_id % 50 AS code, ts AS fetched_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) - CAST(event_id % 6 AS INTEGER) END AS published FROM events WHERE event_id % 5 <> 0)
SELECT a.id, n.news_id FROM a JOIN n ON a.code = n.code AND n.fetched_at BETWEEN a.created_at - INTERVAL 6 HOUR AND a.created_at + INTERVAL 6 HOUR AND n.published BETWEEN CAST(a.created_at AS DATE) - 2 AND CAST(a.created_at AS DATE) + 1""")
def stream_news_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams over the events, one of analyses and one of news, joined as they come."""
    k, code = F.col("event_id"), (F.col("user_id") % 50).alias("code")
    a = _events(spark, sf_dir).where("event_id % 5 = 0").select(k.alias("id"), code, F.col("ts").alias("created_at"))
    n = _events(spark, sf_dir).where("event_id % 5 <> 0").select(k.alias("news_id"), code, F.col("ts").alias("fetched_at"), F.when(k % 7 == 0, None).otherwise(F.date_sub(F.to_date("ts"), (k % 6).cast("int"))).alias("published"))
    both = streams.news_of_analyses(a, n, delay="60 days").select("id", "news_id")
    return streams.drained(f"n{uuid.uuid4().hex}", both, _checkpoint(spark)).where("news_id is not null")


_QUOTE = """SELECT b.code, b.day + %(days)s AS date, close + %(add)s AS price, CASE WHEN n %% 5 = 0 THEN close * 2 WHEN n %% 5 = 1 THEN 0.0 END AS open, CASE WHEN n %% 7 = 0 THEN close * 3 END AS pre_close, CASE WHEN n %% 2 = 0 THEN close * 4 END AS high,
  CASE WHEN n %% 3 = 0 THEN close / 4 END AS low, CASE WHEN n %% 4 = 0 THEN NULL WHEN n %% 4 = 1 THEN 0.0 ELSE 7.0 END AS volume, CASE WHEN n %% 3 = 1 THEN 9.0 END AS amount, CASE WHEN n %% 3 = 2 THEN 1.5 END AS pct_chg FROM (SELECT *, date AS day, CAST(code AS INTEGER) AS n FROM last0) b WHERE %(where)s"""
_FIRST = _QUOTE % {"days": "CASE WHEN n % 2 = 0 THEN 0 WHEN n % 3 = 0 THEN -5 ELSE 3 END", "add": "n % 3 * 0.5", "where": "n % 11 <> 1"}
_SECOND = _QUOTE % {"days": "40", "add": "1.0", "where": "n % 6 <> 5"}


def _merged(quotes: str, last: str) -> str:
    return f"""SELECT q.code, CASE WHEN q.date <= l.date THEN l.date ELSE q.date END AS date, coalesce(nullif(q.open, 0), nullif(q.pre_close, 0), l.close) AS open, coalesce(nullif(q.high, 0), q.price) AS high, coalesce(nullif(q.low, 0), q.price) AS low, q.price AS close,
    coalesce(nullif(q.volume, 0), CASE WHEN q.date <= l.date THEN l.volume ELSE 0 END) AS volume, coalesce(q.amount, CASE WHEN q.date <= l.date THEN l.amount ELSE 0 END) AS amount, coalesce(q.pct_chg, CASE WHEN q.date <= l.date THEN l.pct_chg ELSE 0 END) AS pct_chg FROM {quotes} q JOIN {last} l ON l.code = q.code WHERE q.price > 0"""


@query(f"""WITH {BARS}, b0 AS (SELECT *, 0.25::DOUBLE AS pct_chg FROM bars), last0 AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1), q1 AS ({_FIRST}), m1 AS ({_merged('q1', 'last0')}),
  b1 AS (SELECT * FROM b0 WHERE (code, date) NOT IN (SELECT (code, date) FROM m1) UNION ALL BY NAME SELECT * FROM m1), last1 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1), q2 AS ({_SECOND}), m2 AS ({_merged('q2', 'last1')}), b2 AS (SELECT * FROM b1 WHERE (code, date) NOT IN (SELECT (code, date) FROM m2) UNION ALL BY NAME SELECT * FROM m2)
SELECT code, date, open, high, low, close, volume, {R('amount')}, pct_chg FROM b2""")
def stream_bar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of quotes; the stream is stopped after the first and started again on its checkpoint."""
    b = bars(spark, sf_dir).withColumn("pct_chg", F.lit(0.25)).select("code", "date", *streams.BAR)
    folder = writes.scratch(spark, "quotes")
    store = versions.Versions(spark, f"{folder}/store")
    streams.store_bars(store, b)
    last = store.read("last").withColumns({"n": F.col("code").cast("int"), "at": F.lit(1)})
    n, close = F.col("n"), F.col("close")

    def quotes(days, price) -> DataFrame:
        return last.select(
            "code", F.date_add("date", days).alias("date"), "at", price.alias("price"), F.when(n % 5 == 0, close * 2).when(n % 5 == 1, 0.0).alias("open"), F.when(n % 7 == 0, close * 3).alias("pre_close"), F.when(n % 2 == 0, close * 4).alias("high"),
            F.when(n % 3 == 0, close / 4).alias("low"), F.when(n % 4 == 1, 0.0).when(n % 4 > 1, 7.0).alias("volume"), F.when(n % 3 == 1, 9.0).alias("amount"), F.when(n % 3 == 2, 1.5).alias("pct_chg"),
        )

    first = quotes(F.when(n % 2 == 0, 0).when(n % 3 == 0, -5).otherwise(3), close + n % 3 * 0.5).where(F.col("code").cast("int") % 11 != 1)
    second = quotes(F.lit(40), close + 1.0).where(F.col("code").cast("int") % 6 != 5)
    second = writes.kept(second, "quotes")  # read before the first batch changes what is last
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        streams.upsert_stream(stream, store, f"{folder}/checkpoint")
    return store.read("bars").select("code", "date", "open", "high", "low", "close", "volume", *r("amount"), "pct_chg")
