"""Queries on JSON payloads, on labels and formats of numbers, and on brokers' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import payloads as p
from marketloom.functions import text
from marketloom.functions.rounding import R, r
from marketloom.operators import market
from marketloom.operators.numbering import numbered
from marketloom.plans.registry import query
from marketloom.sources import brokers
from marketloom.sources.testdata import table

_O = F.col


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, floor(o_totalprice) AS v FROM orders)
SELECT id, CASE WHEN k < 4 THEN v END AS ideal_buy, NULL::DOUBLE AS secondary_buy, CASE WHEN k < 4 THEN v / 2 END AS stop_loss, CASE WHEN k = 0 THEN v + 0.5 END AS take_profit FROM x""")
def price_points_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = _O("o_orderkey") % 7, F.floor("o_totalprice").cast("string")
    points = F.concat(F.lit('"ideal_buy": "约 '), v, F.lit('元", "stop_loss": "MA5 下方 '), (F.floor("o_totalprice") / 2).cast("string"), F.lit(' 元", "secondary_buy": null'))
    d = (
        F.when(k == 0, F.concat(F.lit("{"), points, F.lit(', "take_profit": '), (F.floor("o_totalprice") + 0.5).cast("string"), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"sniper_points": {'), points, F.lit("}}")))
        .when(k == 2, F.concat(F.lit('{"sniper_points": {}, "battle_plan": {"sniper_points": {'), points, F.lit("}}}")))
        .when(k == 3, F.concat(F.lit('{"dashboard": {"battle_plan": {"sniper_points": {'), points, F.lit("}}}}")))
        .when(k == 4, '{"battle_plan": {"sniper_points": []}, "other": 1}').when(k == 5, "no json {")
    )
    return table(spark, sf_dir, "orders").select(_O("o_orderkey").alias("id"), p.price_points(d).alias("p")).select("id", "p.*")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1) THEN CAST(o_orderdate AS DATE) - 3 ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def analysis_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = _O("o_orderkey") % 6, F.date_format(F.date_sub(F.to_date("o_orderdate"), 3), "yyyy-MM-dd")
    named = lambda d: F.concat(F.lit('{"enhanced_context": {"date": "'), d, F.lit('"}}'))
    s = F.when(k == 0, named(day)).when(k == 1, named(F.concat(day, F.lit("T09:30:00")))).when(k == 2, named(F.lit("soon"))).when(k == 3, '{"enhanced_context": 5}').when(k == 4, "{broken")
    return table(spark, sf_dir, "orders").select(_O("o_orderkey").alias("id"), p.analysis_day(s, _O("o_orderdate")).alias("day"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '{"revenue":1}' WHEN 1 THEN '{"revenue":2}' WHEN 5 THEN '{"revenue":2}' END AS financial_report, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"ttm":3}' WHEN 5 THEN '{"ttm":3}' END AS dividend_metrics FROM orders""")
def fundamental_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _O("o_orderkey") % 6
    inner = '{"earnings":{"data":{"financial_report":{"revenue":1},"dividend":{}}}}'
    stored = '{"earnings":{"data":{"financial_report":{"revenue":2},"dividend":{"ttm":3}}}}'
    snapshot = F.when(k == 0, '{"enhanced_context":{"fundamental_context":' + inner + "}}").when(k == 1, '{"enhanced_context":{"fundamental_context":[1]}}').when(k == 2, '{"enhanced_context":{"fundamental_context":{"earnings":[]}}}').when(k == 3, "{}").when(k == 4, "text")
    fallback = F.when(k.isin(1, 2, 5), stored).when(k == 4, "[1]")
    ctx = p.fundamental_context(snapshot, fallback)
    return table(spark, sf_dir, "orders").select(_O("o_orderkey").alias("id"), p.fundamental_details(ctx).alias("d")).select("id", "d.*")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_custkey % 3 AS c FROM orders)
SELECT id, concat_ws(',', CASE WHEN k = 0 THEN 'sentiment_score' END, CASE WHEN k = 1 THEN 'operation_advice' END, CASE WHEN k = 2 THEN 'analysis_summary' END, CASE WHEN k IN (3, 4) THEN 'dashboard.core_conclusion.one_sentence' END, CASE WHEN k IN (2, 4) THEN 'dashboard.intelligence.risk_alerts' END,
  CASE WHEN c < 2 AND k IN (1, 3, 4) THEN 'dashboard.battle_plan.sniper_points.stop_loss' END) AS missing FROM x""")
def report_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = _O("o_orderkey") % 5, _O("o_custkey") % 3
    d = (
        F.when(k == 0, '{"core_conclusion":{"one_sentence":"x"},"intelligence":{"risk_alerts":[]},"battle_plan":{"sniper_points":{"stop_loss":5}}}')
        .when(k == 1, '{"core_conclusion":{"one_sentence":"x"},"intelligence":{"risk_alerts":["a"]},"battle_plan":{"sniper_points":{"stop_loss":" "}}}')
        .when(k == 2, '{"core_conclusion":{"one_sentence":"x"},"intelligence":{},"battle_plan":{"sniper_points":{"stop_loss":"5"}}}')
        .when(k == 3, '{"core_conclusion":{"one_sentence":" "},"intelligence":{"risk_alerts":[]},"battle_plan":[]}')
    )
    missing = p.missing_fields(F.when(k != 0, 50), F.when(k != 1, "buy").otherwise(" "), F.when(k != 2, "s"), F.when(c == 0, "buy").when(c == 1, "hold").otherwise("sell"), d)
    return table(spark, sf_dir, "orders").select(_O("o_orderkey").alias("id"), F.concat_ws(",", missing).alias("missing"))


_SIG = "CASE event_id % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'hold' WHEN 2 THEN 'sell' ELSE 'odd' END"


@query(f"""WITH e AS (SELECT event_id AS id, value AS v, {_SIG} AS s FROM events)
SELECT id, CASE WHEN v / 100 >= 0.75 THEN '高' WHEN v / 100 >= 0.45 THEN '中' ELSE '低' END AS confidence, CASE s WHEN 'buy' THEN greatest(60, least(79, floor(v))) WHEN 'hold' THEN greatest(40, least(59, floor(v))) WHEN 'sell' THEN greatest(0, least(39, floor(v))) ELSE greatest(0, least(100, floor(v))) END::BIGINT AS clamped,
  CASE s WHEN 'buy' THEN 'hold' WHEN 'hold' THEN 'sell' ELSE s END AS downgraded,
  CASE WHEN v * 1e4 >= 1e8 THEN printf('%.2f 亿股', v * 1e4 / 1e8) WHEN v * 1e4 >= 1e4 THEN printf('%.2f 万股', floor(v) * 1e4 / 1e4) ELSE 'few' END AS shares, CASE WHEN id % 7 = 0 THEN 'N/A' ELSE printf('%.2f%%', floor(v)) END AS pct FROM e""")
def labels_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = _O("event_id"), _O("value")
    s = F.when(k % 4 == 0, "buy").when(k % 4 == 1, "hold").when(k % 4 == 2, "sell").otherwise("odd")
    shares = F.when((v * 1e4 >= 1e8) | (v * 1e4 < 1e4), F.when(v * 1e4 >= 1e8, p.shares_text(v * 1e4)).otherwise("few")).otherwise(p.shares_text(F.floor(v) * 1e4))
    return table(spark, sf_dir, "events").select(
        k.alias("id"), p.confidence_label(v / 100).alias("confidence"), p.clamped_score(F.floor(v), s).alias("clamped"), p.downgraded(s).alias("downgraded"), shares.alias("shares"), p.percent_text(F.when(k % 7 != 0, F.floor(v).cast("double"))).alias("pct"))


@query("""WITH e AS (SELECT event_id AS id, value AS v, value / 100 AS profit, (event_id % 40) / 100.0::DOUBLE AS c90, 10.0::DOUBLE AS cost, 6.0::DOUBLE + event_id % 9 AS price FROM events)
SELECT id, CASE WHEN profit >= 0.9 THEN '获利盘极高(获利盘>90%)' WHEN profit >= 0.7 THEN '获利盘较高(获利盘70-90%)' WHEN profit >= 0.5 THEN '获利盘中等(获利盘50-70%)' WHEN profit >= 0.3 THEN '套牢盘中等(套牢盘50-70%)' WHEN profit >= 0.1 THEN '套牢盘较高(套牢盘70-90%)' ELSE '套牢盘极高(套牢盘>90%)' END || '，'
  || CASE WHEN c90 < 0.08 THEN '筹码高度集中' WHEN c90 < 0.15 THEN '筹码较集中' WHEN c90 < 0.25 THEN '筹码分散度中等' ELSE '筹码较分散' END || '，'
  || CASE WHEN (price - cost) * 100 / cost > 20 THEN printf('现价高于平均成本%.1f%%', (price - cost) * 100 / cost) WHEN (price - cost) * 100 / cost > 5 THEN printf('现价略高于成本%.1f%%', (price - cost) * 100 / cost) WHEN (price - cost) * 100 / cost > -5 THEN '现价接近平均成本' ELSE printf('现价低于平均成本%.1f%%', abs((price - cost) * 100 / cost)) END AS status FROM e""")
def chip_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _O("event_id")
    return table(spark, sf_dir, "events").select(k.alias("id"), p.chip_status(_O("value") / 100, k % 40 / F.lit(100.0), F.lit(10.0), F.lit(6.0) + k % 9).alias("status"))


@query("""WITH x AS (SELECT p_partkey AS id, ['12.9', '-3.7', ' 5 ', '-', '--', '', 'abc', '1e3'][p_partkey % 8 + 1] AS t FROM part) SELECT id, CASE id % 8 WHEN 0 THEN 12 WHEN 1 THEN -3 WHEN 2 THEN 5 WHEN 7 THEN 1000 END::BIGINT AS n FROM x""")
def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, ("12.9", "-3.7", " 5 ", "-", "--", "", "abc", "1e3"))), (_O("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(_O("p_partkey").alias("id"), p.whole(t).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '6' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || ',000001,880001,031234' WHEN doc_id % 3 = 1 THEN '' ELSE '300750,920001' END AS codes FROM documents")
def codes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _O("doc_id") % 3
    own = F.concat(F.lit("6"), F.lpad((_O("doc_id") % 100000).cast("string"), 5, "0"))
    t = F.when(k == 0, F.concat(F.lit("买入"), own, F.lit("，并关注 000001、880001,031234 与"), own, F.lit("."))).when(k == 1, "订单16005190 与 12345、910001、500001").otherwise("SZ300750!920001")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", text.codes_in(t)).alias("codes"))


#: Questions and the code that each is about; {} is six digits, five digits or letters made from the row's id.
QUESTIONS = (("分析{six}走势", "{six}"), ("How is hk{five} now", "HK{five}"), ("Should I BUY {us} today", ""), ("what about {us}.A?", "{us}.A"), ("{low}", "{us}"), ("分析 {low} 股票", "{us}"), ("please look at {low}", ""), ("看看 the {low}", "{us}"), ("THE", ""), ("", ""), (None, ""), ("订单1{six}", ""), ("xhk{five}", ""), ("Hey {us}", "{us}"))


def _filled_in(t: str, of: str) -> str:
    t = "'" + t.replace("{six}", f"' || {of}six || '").replace("{five}", f"' || {of}five || '").replace("{us}", f"' || {of}us || '").replace("{low}", f"' || lower({of}us) || '") + "'"
    return f"({t})"


_CASES = lambda i: f"CASE doc_id % {len(QUESTIONS)} " + " ".join(f"WHEN {k} THEN {_filled_in(q[i], '')}" for k, q in enumerate(QUESTIONS) if q[i] is not None) + " END"
_OWN = "SELECT doc_id, '3' || lpad(CAST(doc_id % 100000 AS {s}), 5, '0') AS six, lpad(CAST(doc_id % 100000 AS {s}), 5, '0') AS five, 'ZQ' || chr(CAST(65 + doc_id % 26 AS INT)) AS us FROM documents"


@query(f"WITH d AS ({_OWN.format(s='VARCHAR')}) SELECT doc_id, {_CASES(1)} AS code FROM d")
def code_asked_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("3"), F.lpad((_O("doc_id") % 100000).cast("string"), 5, "0")).alias("six"), F.lpad((_O("doc_id") % 100000).cast("string"), 5, "0").alias("five"), F.expr("'ZQ' || chr(65 + doc_id % 26)").alias("us"))
    return rows.select("doc_id", text.code_in(F.expr(_CASES(0))).alias("code"))


@query("""WITH e AS (SELECT event_id AS id, 10 + value / 10 AS c, 10 + (event_id % 7) / 2.0::DOUBLE AS a, 10 + (event_id % 5) / 2.0::DOUBLE AS b, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 10 + (event_id % 3) / 2.0::DOUBLE END AS d FROM events)
SELECT id, CASE WHEN c > a AND a > b AND b > coalesce(d, 0) AND coalesce(d, 0) > 0 THEN '多头排列 📈' WHEN c < a AND a < b AND b < coalesce(d, 0) AND coalesce(d, 0) > 0 THEN '空头排列 📉' WHEN c > a AND a > b THEN '短期向好 🔼' WHEN c < a AND a < b THEN '短期走弱 🔽' ELSE '震荡整理 ↔️' END AS status FROM e""")
def ma_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _O("event_id")
    m = lambda n: F.lit(10.0) + k % n / 2
    return table(spark, sf_dir, "events").select(k.alias("id"), text.ma_status(F.lit(10.0) + _O("value") / 10, m(7), m(5), F.when(k % 11 != 0, m(3))).alias("status"))


_SIDES = ("证券买入", "买 入", "B", "普通卖出", "卖出成交", "s", "转托管")


@query(f"""WITH x AS (SELECT l_orderkey AS o, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS e, CAST(row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS INTEGER) AS line, l_suppkey % 3 AS b, l_orderkey % 7 AS s, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT CAST(b AS INTEGER) AS broker, line, d AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN s < 3 THEN 'buy' ELSE 'sell' END AS side, q AS quantity, 2.5::DOUBLE AS price, 1.75::DOUBLE AS fee, CASE WHEN b = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS tax, CASE WHEN b = 2 THEN 'u' || o END AS trade_uid, CASE WHEN b = 0 THEN 'CNY' END AS currency,
  sha256(CAST(d AS VARCHAR) || '|' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '|' || CASE WHEN s < 3 THEN 'buy' ELSE 'sell' END || '|' || printf('%.8f', q) || '|2.50000000|1.75000000|' || CASE WHEN b = 1 THEN '0.50000000' ELSE '0.00000000' END || '|' || CASE WHEN b = 0 THEN 'CNY' ELSE '' END || '|' || line) AS dedup_hash FROM x WHERE s < 6 AND NOT (o % 11 = 3)""")
def broker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three brokers' files, with their own headers; some have no side, some no price."""
    order = ("b", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("b", _O("l_suppkey") % 3).select(*order, "l_quantity", "l_shipdate")
    rows = numbered(rows, [_O(c) for c in order])  # three brokers are too few for a window each
    first = rows.groupBy("b").agg(F.min("n").alias("first"))  # a row for each broker
    rows = rows.join(F.broadcast(first), "b").withColumn("line", (_O("n") - _O("first") + 2).cast("int"))
    side = F.element_at(F.array(*map(F.lit, _SIDES)), (_O("l_orderkey") % 7 + 1).cast("int"))
    price = F.when(_O("l_orderkey") % 11 == 3, "-").otherwise("2.5")
    code, n, day = F.lpad(_O("l_suppkey").cast("string"), 6, "0"), F.format_string("%,.2f", "l_quantity"), F.to_date("l_shipdate")
    cells = {
        0: ("huatai", {"成交日期": F.date_format(day, "yyyyMMdd"), "证券代码": code, "买卖标志": side, "成交数量": n, "成交均价": F.lit(" "), "价格": price, "手续费": F.lit("1.5"), "过户费": F.lit("0.25"), "币种": F.lit("cny")}),
        1: ("zhongxin", {"发生日期": F.date_format(day, "yyyy-MM-dd"), "代码": code, "业务名称": side, "数量": n, "成交价格": price, "佣金": F.lit("1.75"), "税费": F.lit("0.5")}),
        2: ("cmb", {"日期": F.date_format(day, "yyyy/MM/dd"), "股票代码": code, "交易方向": side, "成交股数": n, "均价": price, "规费": F.lit("1.75"), "流水号": F.concat(F.lit("u"), _O("l_orderkey").cast("string"))}),
    }
    out = None
    for k, (name, headers) in cells.items():
        some = rows.where(F.col("b") == k).select(F.lit(k).alias("broker"), "line", F.create_map(*(x for h, v in headers.items() for x in (F.lit(h), v))).alias("cells"))
        done = brokers.normalized(some, name)
        out = done if out is None else out.unionByName(done)
    return out


@query(f"""WITH c AS (SELECT p_size AS code, p_partkey AS price, p_retailprice AS percent FROM part), w AS (SELECT code, coalesce(sum(percent) FILTER (WHERE price <= 100), 0.0) / sum(percent) AS profit FROM c GROUP BY code) SELECT code, {R('profit')} FROM w""")
def chip_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last distribution of each code (chips of one source), as chip_metrics reads it."""
    c = table(spark, sf_dir, "part").select(F.col("p_size").alias("code"), F.col("p_partkey").alias("price"), F.col("p_retailprice").alias("percent"))
    prices = c.select("code").distinct().withColumn("close", F.lit(100.0))
    return market.chip_metrics(c, prices).select("code", F.coalesce("profit_ratio", F.lit(0.0)).alias("profit")).select("code", *r("profit"))
