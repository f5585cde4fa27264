"""Queries on quotes, names and blocks of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import quotes as q
from marketloom.plans.portfolio import RATES_SQL, rates
from marketloom.plans.registry import query
from marketloom.sources.testdata import INSTRUMENTS, instruments, table

QUOTES = f"""k AS (SELECT s_suppkey AS s, unnest([0, 1, 2, 3]) AS k FROM supplier), quotes AS (
  SELECT s AS code, k AS priority, 'src' || k AS source, CASE (s * 7 + k) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE s + k / 4.0 END::DOUBLE AS price, {', '.join(f"CASE WHEN (s + k * 3 + {i * 2}) % {3 + i} <> 1 THEN (s * 10 + k + {i})::DOUBLE END AS {f}" for i, f in enumerate(q.SUPPLEMENT))} FROM k)"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("k")
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    price = F.when((s * 7 + k) % 5 == 0, None).when((s * 7 + k) % 5 == 1, 0.0).otherwise(s + k / 4)
    return rows.select(s.alias("code"), k.alias("priority"), F.concat(F.lit("src"), k.cast("string")).alias("source"), price.alias("price"), *(F.when((s + k * 3 + i * 2) % (3 + i) != 1, (s * 10 + k + i).cast("double")).alias(f) for i, f in enumerate(q.SUPPLEMENT)))


@query(f"""WITH {QUOTES}, v AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority) AS r FROM quotes WHERE price > 0), a AS (SELECT *, {' OR '.join(f'{f} IS NULL' for f in q.SUPPLEMENT)} AS lacks FROM v WHERE r = 1), b AS (SELECT * FROM v WHERE r = 2)
SELECT a.code, a.source, a.price, CASE WHEN a.lacks THEN b.source END AS supplement, {', '.join(f'coalesce(a.{f}, b.{f}) AS {f}' for f in q.SUPPLEMENT)} FROM a LEFT JOIN b ON a.code = b.code""")
def realtime_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.merged_quotes(_quotes(spark, sf_dir))


@query(f"""WITH {QUOTES}, g AS (SELECT code AS kind, priority, source, coalesce(price > 0, false) AS ok FROM quotes), m AS (SELECT kind, min(priority) AS best FROM g WHERE ok GROUP BY kind)
SELECT kind, priority, source, (SELECT string_agg(x.source || ':' || CASE WHEN x.ok THEN 'ok' ELSE 'failed' END, ',' ORDER BY x.priority) FROM g x WHERE x.kind = g.kind AND x.priority <= m.best) AS chain FROM g JOIN m USING (kind) WHERE priority = best""")
def source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir).select(F.col("code").alias("kind"), "priority", "source", F.coalesce(F.col("price") > 0, F.lit(False)).alias("ok"))
    return q.first_source(rows).withColumn("chain", F.concat_ws(",", "chain"))


@query(f"""WITH {INSTRUMENTS}, a AS (SELECT code, CASE CAST(code AS INTEGER) % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN code WHEN 2 THEN '股票' || code WHEN 3 THEN NULL ELSE 'quoted ' || name END AS name FROM instruments),
  b AS (SELECT code, 'mapped ' || name AS name FROM instruments WHERE CAST(code AS INTEGER) % 10 IN (0, 1)), c AS (SELECT code, CASE CAST(code AS INTEGER) % 10 WHEN 2 THEN ' -- ' WHEN 3 THEN '' ELSE 'listed ' || name END AS name FROM instruments)
SELECT i.code, CASE WHEN CAST(i.code AS INTEGER) % 5 = 4 THEN a.name WHEN b.name IS NOT NULL THEN b.name WHEN CAST(i.code AS INTEGER) % 10 NOT IN (2, 3) THEN c.name ELSE '' END AS name FROM instruments i JOIN a USING (code) LEFT JOIN b USING (code) JOIN c USING (code)""")
def name_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir).select("code", "name")
    n = F.col("code").cast("int")
    first = i.select("code", F.when(n % 5 == 0, "N/A").when(n % 5 == 1, F.col("code")).when(n % 5 == 2, F.concat(F.lit("股票"), "code")).when(n % 5 == 3, None).otherwise(F.concat(F.lit("quoted "), "name")).alias("name"))
    second = i.where((n % 10).isin(0, 1)).select("code", F.concat(F.lit("mapped "), "name").alias("name"))
    third = i.select("code", F.when(n % 10 == 2, " -- ").when(n % 10 == 3, "").otherwise(F.concat(F.lit("listed "), "name")).alias("name"))
    return q.resolved_names(i, [first, second, third])


@query(f"""WITH {RATES_SQL}, c AS (SELECT from_currency || to_currency AS pair, rate_date AS date, CASE WHEN NOT is_stale THEN rate END AS close FROM rates), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "on" FROM orders), p AS (SELECT DISTINCT pair FROM c)
SELECT pair, "on", (SELECT arg_max(c.close, c.date) FROM c WHERE c.pair = p.pair AND c.close IS NOT NULL AND c.date BETWEEN d."on" - 7 AND d."on") AS close FROM d, p""")
def fx_last_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = rates(spark).select(F.concat("from_currency", "to_currency").alias("pair"), F.col("rate_date").alias("date"), F.when(~F.col("is_stale"), F.col("rate")).alias("close"))
    pairs = [r["pair"] for r in closes.select("pair").distinct().collect()]  # two
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("on")).distinct().withColumn("pair", F.explode(F.array(*map(F.lit, pairs))))
    return q.last_close_within(days, closes).select("pair", "on", "close")


_PAYLOADS = ("{\"pe\": 12}", " ", "n/a", None)
_FALLBACKS = ("ok", "failed", "partial", "not_supported", "odd")
BLOCKS = f"""b0 AS (SELECT s_suppkey AS s, unnest(range(7)) AS k FROM supplier), blocks AS (SELECT s AS code, [{', '.join(f"'{x}'" for x in q.BLOCKS)}][k + 1] AS block,
  ['{{"pe": 12}}', ' ', 'n/a', NULL][(s + k) % 4 + 1] AS payload, ['ok', 'failed', 'partial', 'not_supported', 'odd'][(s * 3 + k) % 5 + 1] AS fallback FROM b0 WHERE (s + k) % 6 <> 0 AND s % 13 <> 5)"""


@query(f"""WITH {BLOCKS}, st AS (SELECT *, CASE WHEN payload IS NOT NULL AND lower(trim(payload)) NOT IN ('', '-', 'nan', 'none', 'null', 'n/a', 'na') THEN 'ok' WHEN fallback IN ('failed', 'partial', 'not_supported') THEN fallback ELSE 'partial' END AS status FROM blocks),
  w AS (SELECT s.s_suppkey AS code, s_suppkey % 7 = 2 AS is_etf, {', '.join(f"coalesce(max(status) FILTER (WHERE block = '{b}'), 'not_supported') AS {b}" for b in q.BLOCKS)}, coalesce(string_agg(block, ',' ORDER BY block) FILTER (WHERE status = 'ok'), '') AS with_data FROM supplier s LEFT JOIN st ON st.code = s.s_suppkey GROUP BY 1, 2)
SELECT code, {', '.join(q.BLOCKS)}, with_data, CASE WHEN {' AND '.join(f"{b} = 'not_supported'" for b in q.BLOCKS)} THEN 'not_supported' WHEN is_etf OR {' OR '.join(f"{b} IN ('failed', 'partial')" for b in q.BLOCKS)} THEN 'partial' ELSE 'ok' END AS status FROM w""")
def fundamental_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("k")
    of = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    sup = table(spark, sf_dir, "supplier")
    rows = sup.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(((s + k) % 6 != 0) & (s % 13 != 5))
    blocks = rows.select(s.alias("code"), of(q.BLOCKS, k).alias("block"), of(_PAYLOADS, (s + k) % 4).alias("payload"), of(_FALLBACKS, (s * 3 + k) % 5).alias("fallback"))
    return q.fundamental_bundle(sup.select(s.alias("code"), (s % 7 == 2).alias("is_etf")), blocks).withColumn("with_data", F.concat_ws(",", F.array_sort("with_data")))


@query("""WITH i AS (SELECT n_regionkey AS list, n_nationkey AS pos, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN ' ' ELSE NULL END AS ticker, CASE n_nationkey % 4 WHEN 1 THEN lower(n_name) WHEN 2 THEN '' END AS symbol, CASE n_nationkey % 4 WHEN 2 THEN n_name WHEN 3 THEN NULL ELSE 'x' END AS code FROM nation),
  c AS (SELECT list, pos, upper(coalesce(nullif(trim(ticker), ''), nullif(trim(symbol), ''), nullif(trim(code), ''))) AS code FROM i) SELECT list, code, CAST(pos AS BIGINT) AS mentions FROM c WHERE code IN (SELECT upper(n_name) FROM nation) QUALIFY row_number() OVER (PARTITION BY list, code ORDER BY pos) = 1""")
def trending_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, name = table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name")
    item = F.struct(
        k.alias("pos"), F.when(k % 4 == 0, name).when(k % 4 == 1, " ").alias("ticker"), F.when(k % 4 == 1, F.lower(name)).when(k % 4 == 2, "").alias("symbol"), F.when(k % 4 == 2, name).when(k % 4 == 3, None).otherwise("x").alias("code"), k.cast("long").alias("mentions"))
    lists = n.groupBy(F.col("n_regionkey").alias("list")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return q.trending_mentions(lists, n.select(name.alias("code"))).select("list", "code", "mentions")
