"""Queries on write semantics and on reading sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.rounding import R, r
from marketloom.plans.registry import query
from marketloom.sources import writes
from marketloom.sources.testdata import BARS, bars, table


@query(f"WITH {BARS}, n AS (SELECT code, CASE WHEN CAST(code AS INTEGER) % 2 = 0 THEN date ELSE date + 10000 END AS date, close * 2 AS close FROM bars) SELECT code, date, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.code = b.code AND n.date = b.date) UNION ALL SELECT * FROM n")
def upsert_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = bars(spark, sf_dir).select("code", "date", "close")
    new = old.select("code", F.when(F.col("code").cast("int") % 2 == 0, F.col("date")).otherwise(F.date_add("date", 10000)).alias("date"), (F.col("close") * 2).alias("close"))
    return writes.upsert(old, new, ["code", "date"])


@query("""WITH o AS (SELECT c_custkey AS key, c_name AS title, c_mktsegment AS snippet, 'q' || c_nationkey AS query_id FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) || '!' END AS title, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'new' END AS snippet, 'n' || c_nationkey AS query_id FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(o.key, n.key) AS key, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.snippet, ''), o.snippet) AS snippet, coalesce(o.query_id, n.query_id) AS query_id FROM o FULL JOIN n ON o.key = n.key""")
def merge_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("snippet"), F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("query_id"))
    new = c.where(k % 4 != 0).select(k.alias("key"), F.when(k % 5 == 0, "").otherwise(F.concat(F.upper("c_name"), F.lit("!"))).alias("title"), F.when(k % 7 == 0, None).otherwise("new").alias("snippet"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("query_id"))
    return writes.merge_news(old, new)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ids = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return writes.cascade_delete(o.select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, "l_orderkey")[1]


_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in writes.ALLOWED.items() for b in bs)
_STATES = list(writes.ALLOWED)


@query(f"""WITH s AS (SELECT o_orderkey AS run_id, [{', '.join(f"'{x}'" for x in _STATES)}] AS l, o_orderkey % 9 AS a, o_custkey % 9 AS b FROM orders), c AS (SELECT run_id, l[a + 1] AS status, CASE WHEN run_id % 4 = 0 THEN NULL ELSE l[b + 1] END AS to_ FROM s)
SELECT run_id, CASE WHEN (status, to_) IN ({_EDGES}) THEN to_ ELSE status END AS status, CASE WHEN to_ IS NOT NULL THEN (status, to_) IN ({_EDGES}) END AS accepted FROM c""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = lambda c: F.element_at(F.array(*map(F.lit, _STATES)), (F.col(c) % 9 + 1).cast("int"))
    runs = o.select(F.col("o_orderkey").alias("run_id"), state("o_orderkey").alias("status"))
    return writes.change_status(runs, o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("run_id"), state("o_custkey").alias("to")))


@query(f"""WITH {BARS}, a AS (SELECT * FROM bars WHERE CAST(code AS INTEGER) % 3 <> 0), b AS (SELECT * FROM bars),
  p AS (SELECT 0 AS source, code, date, close, volume / 100 * 100.0 AS volume, volume / 100 * 100.0 * close AS amount FROM a UNION ALL SELECT 1, code, date, close, volume, amount / 1000 * 1000.0 FROM b WHERE code NOT IN (SELECT code FROM a)) SELECT source, code, date, close, {R('volume', 'amount')} FROM p""")
def source_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir)
    first = df.where(F.col("code").cast("int") % 3 != 0).select("code", F.col("date").alias("datetime"), "open", "high", "low", "close", F.col("volume").alias("vol"))
    second = df.select("code", F.col("date").alias("trade_date"), "close", (F.col("volume") / 100).alias("vol"), (F.col("amount") / 1000).alias("amount"))
    both = writes.failover([writes.normalize_source(first, "pytdx"), writes.normalize_source(second, "tushare")])
    return both.select("source", "code", "date", "close", *r("volume", "amount"))


@query("""SELECT 'q' || p_partkey AS query_id, p_brand AS code, '{"pe":' || p_size || CASE WHEN p_partkey % 4 <> 0 THEN ',"kind":"' || p_type || '"' ELSE '' END || '}' AS payload FROM part
UNION ALL SELECT 'old' || s_suppkey, 'S', '{}' FROM supplier""")
def fundamental_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots are added to those that are there, each a JSON payload; what a block lacks isn't in it."""
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "supplier").select(F.concat(F.lit("old"), F.col("s_suppkey").cast("string")).alias("query_id"), F.lit("S").alias("code"), F.lit("{}").alias("payload"))
    blocks = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), k.cast("string")).alias("query_id"), F.col("p_brand").alias("code"), F.col("p_size").alias("pe"), F.when(k % 4 != 0, F.col("p_type")).alias("kind"))
    return writes.appended(old, writes.snapshot_rows(blocks))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderpriority AS advice, floor(o_totalprice) AS v FROM orders)
SELECT 'q' || k AS query_id, 'c' || (k % 50) AS code, k % 101 AS score, advice, CASE WHEN k % 3 = 0 THEN v WHEN k % 3 = 1 THEN v END AS ideal_buy, CASE WHEN k % 3 = 0 THEN v / 2 END AS secondary_buy, CASE WHEN k % 3 <> 2 THEN v - 1 END AS stop_loss, CASE WHEN k % 3 = 1 THEN v + 0.5 END AS take_profit FROM x
UNION ALL SELECT 'old' || c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer""")
def analysis_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses are added to the history with the prices that their dashboards name, wherever they stand in them."""
    k, v = F.col("o_orderkey"), F.floor("o_totalprice")
    said = lambda c: c.cast("string")
    flat = F.concat(F.lit('{"ideal_buy": "'), said(v), F.lit('元", "secondary_buy": "MA20 附近 '), said(v / 2), F.lit(' 元", "stop_loss": '), said(v - 1), F.lit("}"))
    deep = F.concat(F.lit('{"battle_plan": {"sniper_points": {"ideal_buy": "约 '), said(v), F.lit('元", "stop_loss": "'), said(v - 1), F.lit('元", "take_profit": '), said(v + 0.5), F.lit("}}}"))
    results = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("q"), said(k)).alias("query_id"), F.concat(F.lit("c"), said(k % 50)).alias("code"), (k % 101).alias("score"), F.col("o_orderpriority").alias("advice"),
        F.when(k % 3 == 0, flat).when(k % 3 == 1, deep).otherwise('{"summary": "暂无"}').alias("dashboard"))
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("old"), said(F.col("c_custkey"))).alias("query_id"))
    return writes.appended(writes.history_rows(results), old)


@query("""WITH l AS (SELECT o_orderkey % 16 AS report, '## ' || o_orderkey AS value FROM orders UNION ALL SELECT o_orderkey % 16, '评分 ' || (o_orderkey % 101) || ' ' || o_orderpriority FROM orders) SELECT CAST(report AS INTEGER) AS report, value FROM l""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines for each analysis, written as text files by report and read back."""
    k = F.col("o_orderkey")
    lines = F.array(F.concat(F.lit("## "), k.cast("string")), F.concat(F.lit("评分 "), (k % 101).cast("string"), F.lit(" "), "o_orderpriority"))
    path = writes.scratch(spark, "reports")
    writes.report_files(table(spark, sf_dir, "orders").select((k % 16).alias("report"), "o_orderkey", F.posexplode(lines).alias("n", "value")).select("report", F.struct("o_orderkey", "n").alias("ord"), "value"), path)
    return spark.read.text(path).select("report", "value")
