"""Queries on what sources deliver: ranges, cleaning, dates, boards, columns by keyword, keyed writes, users' rules and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import misc
from marketloom.operators.indicators import moving_averages
from marketloom.plans.registry import query
from marketloom.plans.tools import matching_rules
from marketloom.sources import imports, writes
from marketloom.sources import bars as source
from marketloom.sources.testdata import BARS, INSTRUMENTS, bars, instruments, table


@query(f"WITH {BARS} SELECT code, date, close FROM bars WHERE code = '000003' AND date BETWEEN DATE '1999-03-05' AND DATE '2000-03-05'")
def bars_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.date_range(bars(spark, sf_dir), "000003", "1999-03-05", "2000-03-05").select("code", "date", "close")


@query(f"WITH {BARS} SELECT code, date, open, high, low, close, volume FROM bars")
def bar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars, written as CSV files by symbol and read back by the data source of such files."""
    path = writes.scratch(spark, "bar-files")
    bars(spark, sf_dir).drop("amount").repartition("code").write.partitionBy("code").option("header", True).option("maxRecordsPerFile", 1_000_000).csv(path)
    return source.of_files(spark, path)


@query("""WITH x AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_extendedprice AS e, l_quantity AS q, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT CAST(o AS VARCHAR) || '-' || n || '-' || p AS code, d AS date, CASE WHEN o % 3 = 0 THEN NULL ELSE q END AS open, floor(e) AS close, q AS volume FROM x WHERE o % 5 <> 1 AND o % 7 <> 2 AND o % 11 <> 3""")
def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("l_orderkey")
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", o.cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("code"), F.when(o % 5 == 1, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.when(o % 3 == 0, "--").otherwise(F.col("l_quantity").cast("string")).alias("open"), F.when(o % 7 == 2, "").otherwise(F.floor("l_extendedprice").cast("string")).alias("close"), F.when(o % 11 == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("volume"))
    return source.clean(raw).select("code", "date", "open", "close", "volume")


@query("""SELECT event_id AS id, CASE event_id % 8 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 5 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 1 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at,
  CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(ts AS DATE) END AS listed FROM events""")
def stored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    like = lambda p: F.date_format(ts, p)
    at = F.when(k % 8 == 0, like("yyyy-MM-dd'T'HH:mm:ss")).when(k % 8 == 1, like("yyyy-MM-dd HH:mm")).when(k % 8 == 2, like("yyyy-MM-dd")).when(k % 8 == 3, like("yyyy/MM/dd HH:mm:ss")).when(k % 8 == 4, like("yyyy/M/d HH:mm")).when(k % 8 == 5, like("yyyy/M/d")).when(k % 8 == 6, " ").otherwise("soon")
    listed = F.when(k % 4 == 0, like("yyyyMMdd")).when(k % 4 == 1, like("yyyy-MM-dd")).when(k % 4 == 2, like("yyyy/M/d")).otherwise("-")
    return table(spark, sf_dir, "events").select(k.alias("id"), text.stored_time(at).alias("at"), text.list_day(listed).alias("listed"))


@query("""WITH b AS (SELECT p_size AS code, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS ord, p_partkey % 4 AS k, p_brand AS n, p_type AS t FROM part) SELECT code, ord, n AS name, CASE WHEN k = 0 THEN 'b' || ord END AS board, CASE WHEN k = 1 THEN t END AS type FROM b WHERE k < 3 QUALIFY row_number() OVER (PARTITION BY code, n ORDER BY ord) = 1""")
def normalized_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").withColumn("ord", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1)
    k, s = F.col("p_partkey") % 4, lambda *xs: F.create_map(*xs)
    item = (
        F.when(k == 0, s(F.lit("板块名称"), F.concat(F.lit(" "), "p_brand"), F.lit("代码"), F.concat(F.lit("b"), F.col("ord").cast("string"))))
        .when(k == 1, s(F.lit("name"), F.col("p_brand"), F.lit("type"), F.col("p_type"))).when(k == 2, s(F.lit("板块"), F.lit("nan"), F.lit("industry"), F.col("p_brand"))).otherwise(s(F.lit("name"), F.lit(" "), F.lit("code"), F.lit("x")))
    )
    rows = p.groupBy(F.col("p_size").alias("code")).agg(F.sort_array(F.collect_list(F.struct("ord", F.to_json(item).alias("j")))).alias("xs"))
    return misc.normalized_boards(rows.select("code", F.transform("xs", lambda x: F.from_json(x["j"], "map<string,string>")).alias("items")))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS v FROM orders")
def keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("x").alias("other"), F.when(k == 0, "first").otherwise("-").alias("净利润同比"), F.when(k == 2, "nan").otherwise("second").alias("净利润增长率(%)"))
    return df.select("id", text.by_keywords(df, ("净利润",)).alias("v"))


@query("""WITH o AS (SELECT c_nationkey AS f, c_custkey % 7 AS t, c_custkey AS d, c_acctbal AS rate FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_nationkey AS f, c_custkey % 7 AS t, c_custkey AS d, c_acctbal * 2 AS rate FROM customer WHERE c_custkey % 2 = 0)
SELECT f, t, d, rate, false AS added FROM o WHERE (f, t, d) NOT IN (SELECT (f, t, d) FROM n) UNION ALL SELECT f, t, d, rate, (f, t, d) NOT IN (SELECT (f, t, d) FROM o) FROM n""")
def upsert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by pair and day, and which of them a write counts as added."""
    c, keys = table(spark, sf_dir, "customer"), ["f", "t", "d"]
    rows = c.select(F.col("c_nationkey").alias("f"), (F.col("c_custkey") % 7).alias("t"), F.col("c_custkey").alias("d"), F.col("c_acctbal").alias("rate"))
    old, new = rows.where("d % 3 <> 0"), rows.where("d % 2 = 0").withColumn("rate", F.col("rate") * 2)
    added = writes.inserted(old, new, keys).select(*keys, F.lit(True).alias("added"))
    return writes.upsert(old, new, keys).join(added, keys, "left").fillna(False, ["added"])


@query(f"""WITH {BARS}, m AS (SELECT code, date, close, volume, CASE WHEN count(*) OVER w >= 5 THEN avg(close) OVER w END AS ma5 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT code, date, concat_ws(',', CASE WHEN close > ma5 * 1.5 THEN 'far above' END, CASE WHEN volume > 45 AND close < 20 THEN 'cheap and lively' END) AS rules FROM m""")
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"far above": "close > ma5 * 1.5", "cheap and lively": "volume > 45 and close < 20"}
    return matching_rules(moving_averages(bars(spark, sf_dir)), rules).select("code", "date", F.concat_ws(",", "rules").alias("rules"))


@query("SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def results_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's results, the best first (the order is numbered so that it can be compared)."""
    from pyspark.sql import Window

    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query(f"""WITH {INSTRUMENTS}, x AS (SELECT code, name, CAST(code AS INTEGER) % 5 AS k FROM instruments) SELECT CASE k WHEN 2 THEN NULL WHEN 3 THEN '6' || code[2:] ELSE code END AS code, CASE k WHEN 0 THEN name WHEN 1 THEN NULL WHEN 2 THEN 'nobody' WHEN 3 THEN NULL ELSE name END AS name FROM x""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of watch lists: a code and a name, a code alone, an unknown name, a code where the name should be, a name alone."""
    i = instruments(spark, sf_dir).select("code", "name")
    k = F.col("code").cast("int") % 5
    first = F.when(k == 0, F.concat(F.lit("sh"), "code")).when(k == 1, F.concat("code", F.lit(" .SZ"))).when(k == 2, "nobody").when(k == 4, F.col("name"))
    rows = i.select(first.alias("first"), F.when(k == 0, F.col("name")).when(k == 3, F.concat(F.lit("6"), F.substring("code", 2, 5))).alias("second"))
    return imports.resolved(rows, i).select("code", "name")
