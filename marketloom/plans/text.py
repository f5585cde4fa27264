"""Queries on codes and short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import codes, text
from marketloom.plans.registry import query
from marketloom.sources.testdata import table
from marketloom.sources.writes import kept


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    six = F.lpad((k * 7919 % 1000000).cast("string"), 6, "0")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" sh"), six)).when(k % 6 == 1, F.concat(six, F.lit(".SZ"))).when(k % 6 == 2, F.concat((k % 9999).cast("string"), F.lit(".hk"))).when(k % 6 == 3, F.concat(F.lit("HK"), (k % 9999).cast("string"))).when(k % 6 == 4, F.concat(F.lit("bj"), six)).otherwise("brk.b")
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


RAW = """raw AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' sh' || s WHEN 1 THEN s || '.SZ' WHEN 2 THEN CAST(p_partkey % 9999 AS VARCHAR) || '.hk' WHEN 3 THEN 'HK' || CAST(p_partkey % 9999 AS VARCHAR) WHEN 4 THEN 'bj' || s ELSE 'brk.b' END AS raw
  FROM (SELECT *, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS s FROM part))"""


@query(f"""WITH {RAW}, c AS (SELECT p_partkey, trim(raw) AS own, upper(trim(raw)) AS c FROM raw), n AS (SELECT p_partkey, c, CASE WHEN regexp_matches(c, '^(SH|SZ)[0-9]{{5,6}}$') OR regexp_matches(c, '^BJ[0-9]{{6}}$') THEN substr(c, 3)
  WHEN regexp_matches(c, '^HK[0-9]{{1,5}}$') THEN 'HK' || lpad(substr(c, 3), 5, '0') WHEN regexp_matches(c, '^[0-9]{{1,5}}[.]HK$') THEN 'HK' || lpad(regexp_extract(c, '^([0-9]+)', 1), 5, '0')
  WHEN regexp_matches(c, '^[0-9]{{5,6}}[.](SH|SZ|SS|BJ)$') THEN regexp_extract(c, '^([0-9]+)', 1) ELSE own END AS code FROM c)
SELECT p_partkey, code, CASE WHEN regexp_matches(c, '^HK[0-9]{{1,5}}$') OR regexp_matches(c, '^[0-9]{{1,5}}[.]HK$') OR regexp_matches(c, '^[0-9]{{5}}$') THEN 'hk' WHEN regexp_matches(c, '^[A-Z]{{1,5}}([.][A-Z])?$') THEN 'us' ELSE 'cn' END AS market,
  CASE WHEN substr(code, 1, 3) IN ('600', '601', '603', '605') THEN 'SSE' WHEN substr(code, 1, 3) IN ('000', '001', '002', '003', '300') THEN 'SZSE' WHEN substr(code, 1, 3) = '430' OR substr(code, 1, 2) IN ('83', '87', '92') THEN 'BSE' ELSE 'CN' END AS exchange FROM n""")
def code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _codes(spark, sf_dir).withColumn("code", codes.normalize(F.col("raw")))
    return df.select("p_partkey", "code", codes.market(F.col("raw")).alias("market"), codes.exchange(F.col("code")).alias("exchange"))


#: Codes that meet every branch of the rules.
SAMPLES = ("600519", "601398", "603288", "605001", "604001", "688001", "000001", "001979", "002594", "003816", "004001", "300750", "301001", "430047", "400001", "838163", "870001", "880001", "920001", "900901", "510300", "159915", "HK00700", "hk700", "700.HK", "00700", "HK1234567", "SH600519", "sz000001", "SS600000", "bj920748", "600519.SH", "600519 .ss", "aapl", "BRK.B", "SPX", "^gspc", "GSPC", "DJIA", "^DJI", "NASDAQ", "^ixic", "NDX", "VIX", "^RUT", "SOX", "TOOLONG", "", "12", "hk")
FUND_NAMES = ("Tracker Fund of Hong Kong", "SPDR S&P 500 ETF Trust", "plain company", "")


@query(f"""WITH s AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in SAMPLES)}][p_partkey % {len(SAMPLES)} + 1] AS raw, [{', '.join(f"'{x}'" for x in FUND_NAMES)}][p_partkey // {len(SAMPLES)} % 4 + 1] AS name FROM part),
  c AS (SELECT *, upper(trim(raw)) AS c, split_part(trim(raw), '.', 1) AS stem FROM s), i AS (SELECT *, c IN ('SPX', '^GSPC', 'GSPC', 'DJI', '^DJI', 'DJIA', 'IXIC', '^IXIC', 'NASDAQ', 'NDX', '^NDX', 'VIX', '^VIX', 'RUT', '^RUT') AS idx, regexp_matches(c, '^[A-Z]{{1,5}}([.][A-Z])?$') AS ticker FROM c),
  f AS (SELECT *, regexp_matches(upper(stem), '^[A-Z]{{1,5}}$') OR upper(stem) LIKE 'HK%' OR regexp_matches(stem, '^[0-9]{{5}}$') AS stem_foreign FROM i)
SELECT p_partkey, CASE WHEN idx OR ticker THEN 'us' WHEN (c LIKE '%.HK' AND regexp_matches(c[:-4], '^[0-9]{{1,5}}$')) OR (c LIKE 'HK%' AND regexp_matches(c[3:], '^[0-9]{{1,5}}$')) OR regexp_matches(c, '^[0-9]{{5}}$') THEN 'hk' ELSE 'cn' END AS tag, idx AS us_index,
  length(stem) = 6 AND regexp_matches(stem, '^[0-9]+$') AND (stem[1] IN ('4', '8') OR stem[:2] = '92') AS bse, stem[:3] = '688' OR stem[:2] = '30' AS growth,
  CASE WHEN regexp_matches(c, '^[0-9]{{5,6}}$') OR ticker THEN c WHEN c[-3:] IN ('.SH', '.SZ', '.SS') AND regexp_matches(trim(c[:-4]), '^[0-9]{{5,6}}$') THEN trim(c[:-4]) WHEN c[:2] IN ('SH', 'SZ', 'SS') AND regexp_matches(c[3:], '^[0-9]{{6}}$') THEN c[3:] WHEN c[:2] = 'HK' AND regexp_matches(c[3:], '^[0-9]{{5}}$') THEN c[3:] END AS imported,
  ticker OR c LIKE 'HK%' OR regexp_matches(c, '^[0-9]{{5}}$') AS foreign_,
  stem <> '' AND ((length(stem) = 6 AND regexp_matches(stem, '^[0-9]+$') AND stem[:2] IN ('51', '52', '56', '58', '15', '16', '18')) OR upper(stem) IN ('SPX', '^GSPC', 'GSPC', 'DJI', '^DJI', 'DJIA', 'IXIC', '^IXIC', 'NASDAQ', 'NDX', '^NDX', 'VIX', '^VIX', 'RUT', '^RUT')
    OR (stem_foreign AND regexp_matches(upper(name), 'ETF|FUND|TRUST|INDEX|TRACKER|UNIT'))) AS fund FROM f""")
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    k, raw = F.col("p_partkey"), F.col("raw")
    df = table(spark, sf_dir, "part").select(k, of(SAMPLES, k % len(SAMPLES)).alias("raw"), of(FUND_NAMES, F.floor(k / len(SAMPLES)) % 4).alias("name"))
    return df.select("p_partkey", codes.market_tag(raw).alias("tag"), codes.is_us_index(raw).alias("us_index"), codes.is_bse(raw).alias("bse"), codes.is_growth_board(raw).alias("growth"), codes.import_code(raw).alias("imported"), codes.is_foreign(raw).alias("foreign_"), codes.is_index_or_fund(raw, F.col("name")).alias("fund"))


@query("""SELECT o_orderkey, CASE o_orderkey % 14 WHEN 0 THEN o_totalprice WHEN 1 THEN v WHEN 2 THEN v / 2 WHEN 4 THEN v + 0.5 WHEN 5 THEN v + 0.5 WHEN 6 THEN 1000 + v % 1000 WHEN 7 THEN 0 WHEN 8 THEN -v WHEN 9 THEN 19 WHEN 10 THEN v WHEN 13 THEN v END::DOUBLE AS price FROM (SELECT *, floor(o_totalprice) AS v FROM orders)""")
def price_point_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("o_totalprice")
    n, say = v.cast("string"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    forms = (
        F.col("o_totalprice").cast("string"), say("理想买入点：", n, "元（MA20 附近）"), say("止损: MA5 下方 ", (v / 2).cast("string"), " 元"), F.lit("暂无"), say("约 ", n, ".5 (MA10)"), say("(", n, ".5)"), say("买入：1，", F.lpad((v % 1000).cast("string"), 3, "0"), "元"),
        F.lit(" 0元"), say("-", n), say(n, "-19元"), say(n, "（回踩MA5/10附近）"), F.lit("MA5 与 ma10"), F.lit("—"), say(n, "：元"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.price_point(_form(F.col("o_orderkey"), forms)).alias("price"))


def _form(k: Column, forms: Sequence[Column]) -> Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(k % len(forms) == i, form).otherwise(out)
    return out


@query("""WITH e AS (SELECT event_id, CAST(event_id AS INTEGER) AS n, event_id % 28 AS k, ts, TIMESTAMP '2024-02-01 12:00:00' AS now FROM events)
SELECT event_id, CASE WHEN k IN (7, 24) THEN NULL WHEN k = 3 THEN CAST(now AS DATE) - n % 20 WHEN k = 4 THEN CAST(now AS DATE) - n % 5 * 7 WHEN k = 8 THEN CAST(now AS DATE) - 2 WHEN k = 9 THEN CAST(now AS DATE) - n % 7 * 30 WHEN k = 10 THEN CAST(now - to_minutes(n % 2000) AS DATE)
  WHEN k = 11 THEN CAST(now AS DATE) WHEN k IN (13, 21) THEN CAST(ts - INTERVAL 8 HOUR AS DATE) WHEN k = 23 THEN CAST(now AS DATE) - 1 WHEN k = 25 THEN CAST(now - to_hours(n % 50) AS DATE) WHEN k = 26 THEN CAST(now AS DATE) - n % 3 * 365 ELSE CAST(ts AS DATE) END AS published FROM e""")
def publish_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    at, n = lambda form: F.date_format(ts, form), lambda m: (k % m).cast("string")
    forms = (
        at("yyyy-MM-dd HH:mm:ss"), at("yyyy年M月d日"), F.unix_timestamp(ts).cast("string"), say(n(20), " days ago"), say(n(5), "周前"), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), (F.unix_timestamp(ts) * 1000).cast("string"), F.lit("soon"), F.lit("前天"), say(n(7), " 月前"),
        say(n(2000), " mins ago"), F.lit("Now"), say(at("EEE, dd MMM yyyy HH:mm:ss"), " GMT"), say(at("dd MMM yyyy HH:mm:ss"), " +0800"), at("MMMM d, yyyy"), at("d MMMM yyyy"), say(at("MMM d"), "th, ", at("yyyy")), at("yyyy/MM/dd HH:mm"), at("yyyy.MM.dd"), at("yyyy-M-d"),
        say("发布于", at("yyyy年M月d日"), "，来源"), say(at("yyyy-MM-dd'T'HH:mm:ss"), "+08:00"), at("yyyyMMdd"), F.lit(" Yesterday "), F.lit("2023年13月45日"), say(n(50), " hours ago"), say(n(3), " years ago"), say(at("MMM d, yyyy HH:mm"), " UTC"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.published(_form(k, forms), F.lit("2024-02-01 12:00:00").cast("timestamp")).alias("published"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'sell' WHEN l_returnflag = 'A' THEN 'buy' END AS side, sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || printf('%.8f', l_quantity) || '|' || printf('%.8f', l_extendedprice)) AS hash FROM lineitem""")
def trade_dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "证券卖出").when(F.col("l_returnflag") == "A", " Buy ").otherwise("?")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.trade_side(side).alias("side"), text.dedup_hash(F.col("l_orderkey"), F.col("l_linenumber"), F.format_string("%.8f", "l_quantity"), F.format_string("%.8f", "l_extendedprice")).alias("hash"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 0 THEN (s_suppkey % 9 + 1) / 10.0::DOUBLE WHEN 1 THEN (s_suppkey % 9 + 1) / 10.0::DOUBLE ELSE CAST(s_suppkey % 9 + 1 AS DOUBLE) END AS per_share,
  CASE WHEN abs(s_acctbal) >= 1e8 THEN 'big' WHEN abs(s_acctbal) >= 1e4 THEN printf('%.2f万元', s_acctbal / 1e4) ELSE printf('%.0f元', round(s_acctbal)) END AS amount FROM supplier""")
def dividend_plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = (k % 9 + 1).cast("string")
    plan = F.when(k % 4 == 0, F.concat(F.lit("10派"), n, F.lit("元(含税)"))).when(k % 4 == 1, F.concat(F.lit("每10股派发"), n, F.lit("元"))).when(k % 4 == 2, F.concat(F.lit("每股派"), n, F.lit("元"))).otherwise("10送5")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.dividend_per_share(plan).alias("per_share"), text.amount_text(F.col("s_acctbal")).alias("amount"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS snippet FROM documents""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 2000)).alias("n", "chunk"))


@query()
def name_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents as names; every fiftieth is asked for with two letters changed."""
    names = table(spark, sf_dir, "documents").select(F.substring("text", 1, 16).alias("known"), F.col("doc_id").alias("code")).where("known is not null")
    names = kept(names.groupBy("known").agg(F.min("code").alias("code")), "names")  # the texts are read once
    asked = names.where("code % 50 = 0").select(F.concat(F.substring("known", 1, 3), F.lit("X"), F.substring("known", 5, 6), F.lit("Y"), F.substring("known", 12, 40)).alias("name"))
    return text.fuzzy_names(asked, names)
