"""Queries on histories, candidates, tasks and the write plans of the smaller tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.payloads import amplitude_pct
from marketloom.functions.rounding import R, r
from marketloom.operators import backtest, history, indicators, misc
from marketloom.plans.backtest import SUMMARY, _results
from marketloom.plans.registry import query
from marketloom.sources import writes
from marketloom.sources.testdata import ANALYSES, BARS, INSTRUMENTS, MONTHLY_BARS, analyses, bars, instruments, table


@query("SELECT o_orderkey AS id, o_totalprice AS price, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 7")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return history.page_with_total(rows, [F.desc("price"), F.col("id")], 2, 7)


_A = "avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {BARS}, m AS (SELECT *, {_A.format(4)} AS ma5, {_A.format(9)} AS ma10, {_A.format(19)} AS ma20, lag(close) OVER (PARTITION BY code ORDER BY date) AS pc, lag(volume) OVER (PARTITION BY code ORDER BY date) AS pv, lag(date) OVER (PARTITION BY code ORDER BY date) AS prev_date FROM bars),
  l AS (SELECT *, CASE WHEN pv > 0 THEN volume / pv END AS volume_change_ratio, CASE WHEN pc > 0 THEN (close - pc) * 100 / pc END AS price_change_pct FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, date, prev_date, {R('volume_change_ratio', 'price_change_pct')}, CASE WHEN prev_date IS NULL THEN NULL WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 AND ma20 > 0 THEN '多头排列 📈' WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 AND ma20 > 0 THEN '空头排列 📉' WHEN close > ma5 AND ma5 > ma10 THEN '短期向好 🔼' WHEN close < ma5 AND ma5 < ma10 THEN '短期走弱 🔽' ELSE '震荡整理 ↔️' END AS ma_status FROM l""")
def bar_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bar_context(indicators.lenient_averages(bars(spark, sf_dir))).select("code", "date", "prev_date", *r("volume_change_ratio", "price_change_pct"), "ma_status")


@query(f"""WITH {ANALYSES}, h AS (SELECT *, CASE WHEN id % 6 = 0 THEN NULL ELSE 'q' || (id % 3) END AS query_id FROM analyses WHERE date >= DATE '2001-06-01' - INTERVAL 90 DAY), x AS (SELECT DISTINCT code, 'q1' AS nq FROM analyses WHERE CAST(code AS INTEGER) % 2 = 0),
  k AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY h.code ORDER BY date DESC, id DESC) AS INTEGER) AS rank FROM h LEFT JOIN x USING (code) WHERE nq IS NULL OR query_id <> nq) SELECT id, code, rank FROM k WHERE rank <= 5""")
def recent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyses(spark, sf_dir)
    h = a.select("id", "code", F.when(F.col("id") % 6 == 0, None).otherwise(F.concat(F.lit("q"), (F.col("id") % 3).cast("string"))).alias("query_id"), F.col("date").cast("timestamp").alias("created_at"))
    out = a.where(F.col("code").cast("int") % 2 == 0).select("code").distinct().withColumn("query_id", F.lit("q1"))
    return history.recent_signals(h, F.lit("2001-06-01").cast("timestamp"), out).select("id", "code", "rank")


@query("""WITH c AS (SELECT o_orderkey // 100 AS run_id, o_orderkey AS id, o_custkey % 20 AS code, CAST(o_orderkey % 100 AS INTEGER) AS rank, CASE WHEN o_orderkey % 3 <> 0 THEN 'q' || (o_orderkey % 50) END AS ai_query_id FROM orders),
  res AS (SELECT 'q' || q AS query_id, code, 'summary ' || q AS summary, CASE WHEN q % 2 = 0 THEN 'buy' ELSE 'hold' END AS advice FROM (SELECT unnest(range(50)) AS q), (SELECT unnest(range(20)) AS code) WHERE (q + code) % 3 = 0),
  nw AS (SELECT 'q' || (event_id % 50) AS query_id, user_id % 20 AS code, count(*) AS news_count FROM events GROUP BY 1, 2)
SELECT id, c.code, rank <= 30 AS selected_for_ai, summary AS ai_summary, advice AS ai_advice, coalesce(news_count, 0) AS news_count FROM c LEFT JOIN res ON res.query_id = ai_query_id AND res.code = c.code LEFT JOIN nw ON nw.query_id = ai_query_id AND nw.code = c.code""")
def candidates_with_ai(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("run_id"), k.alias("id"), (F.col("o_custkey") % 20).alias("code"), (k % 100).cast("int").alias("rank"), F.when(k % 3 != 0, F.concat(F.lit("q"), (k % 50).cast("string"))).alias("ai_query_id"))
    q = spark.range(50).select(F.col("id").alias("q")).withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(19)))).where((F.col("q") + F.col("code")) % 3 == 0)
    res = q.select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("query_id"), F.col("code").cast("long").alias("code"), F.concat(F.lit("summary "), F.col("q").cast("string")).alias("summary"), F.when(F.col("q") % 2 == 0, "buy").otherwise("hold").alias("advice"))
    news = table(spark, sf_dir, "events").select(F.concat(F.lit("q"), (F.col("event_id") % 50).cast("string")).alias("query_id"), (F.col("user_id") % 20).alias("code"))
    return history.candidates_with_ai(c, res, news, 30).select("id", "code", "selected_for_ai", "ai_summary", "ai_advice", "news_count")


@query(f"WITH {SUMMARY}, l AS (SELECT code, coalesce(win_rate_pct / 100, 0.5) AS win_rate, coalesce(direction_accuracy_pct / 100, 0.5) AS direction_accuracy, coalesce(coalesce(avg_simulated_return_pct, avg_stock_return_pct) / 100, 0.0) AS avg_return FROM m) SELECT code, {R('win_rate', 'direction_accuracy', 'avg_return', digits=6)} FROM l")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.learning_summary(backtest.summary(_results(spark, sf_dir))).select("code", *r("win_rate", "direction_accuracy", "avg_return", digits=6))


@query(f"WITH {SUMMARY} SELECT code, CASE WHEN code = '__overall__' OR CAST(code AS INTEGER) % 3 = 0 THEN total ELSE -1 END AS total FROM m")
def touched_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _results(spark, sf_dir)
    old = backtest.summary(res).withColumn("total", F.lit(-1).cast("long"))
    return history.touched_summaries(old, res, res.where(F.col("code").cast("int") % 3 == 0)).select("code", "total")


_TASKS = "t AS (SELECT o_orderkey AS id, ['pending', 'processing', 'completed', 'failed'][o_orderkey % 4 + 1] AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (k % 4 + 1).cast("int")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query(f"WITH {_TASKS} SELECT id, status FROM t ORDER BY created_at DESC, id DESC LIMIT 50")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.task_page(_tasks(spark, sf_dir), 50).select("id", "status")


@query(f"WITH {_TASKS}, d AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS n FROM t WHERE status IN ('completed', 'failed')) SELECT id, status FROM t WHERE id NOT IN (SELECT id FROM d WHERE n <= (SELECT greatest(0, count(*) - 1000) FROM t))")
def trimmed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trimmed_tasks(_tasks(spark, sf_dir), 1000).select("id", "status")


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id % 50 AS code, ts AS at, CASE WHEN event_id % 40 = 7 THEN TIMESTAMP '9999-01-01' ELSE ts + to_hours(CAST(event_id % 9 AS INTEGER)) END AS done, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT code, n, id, true AS accepted, done AS until FROM e WHERE n = 1 UNION ALL SELECT e.code, e.n, e.id, e.at >= f.until, CASE WHEN e.at >= f.until THEN e.done ELSE f.until END FROM f JOIN e ON e.code = f.code AND e.n = f.n + 1)
SELECT id, code, accepted FROM f""")
def active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    req = table(spark, sf_dir, "events").select(k.alias("id"), (F.col("user_id") % 50).alias("code"), ts.alias("created_at"), F.when(k % 40 == 7, None).otherwise(ts + F.make_dt_interval(hours=(k % 9).cast("int"))).alias("finished_at"))
    return history.active_tasks(req).select("id", "code", "accepted")


@query(f"WITH {INSTRUMENTS} SELECT code, name FROM instruments WHERE CAST(code AS INTEGER) % 4 <> 1")
def without_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir)
    return history.without_codes(i, i.where(F.col("code").cast("int") % 4 == 1).select(F.concat(F.lit(" "), "code").alias("code"))).select("code", "name")


@query("""WITH x AS (SELECT o_orderkey AS id, ['b', 'a' || (o_orderkey % 3), ' c ', NULL, ''] AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ['a1', 'z', 'b'] END AS q FROM orders)
SELECT id, CASE WHEN id % 4 = 0 THEN 'b,a' || (id % 3) WHEN id % 3 = 1 THEN 'b,a1,z' ELSE 'b,a' || (id % 3) || ',a1,z' END AS merged, 'A' || (id % 3) || ',B,C' AS codes, CASE WHEN id % 4 = 0 THEN 'k' ELSE 'k,n' END AS filled FROM x""")
def list_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.concat(F.lit("a"), (k % 3).cast("string"))
    second = F.when(k % 4 == 0, None).otherwise(F.array(F.lit("a1"), F.lit("z"), F.lit("b")))
    filled = history.filled_entries(F.create_map(F.lit("k"), F.lit(1), F.lit("n"), F.when(k % 4 != 0, 2), F.lit("m"), F.lit(None).cast("int")))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat_ws(",", history.ordered_merge(F.array(F.lit("b"), a), second)).alias("merged"), F.concat_ws(",", history.sorted_codes(F.array(F.lit("b"), a, F.lit(" c "), F.lit(None), F.lit(""), F.lit("B")))).alias("codes"), F.concat_ws(",", F.map_keys(filled)).alias("filled"))


@query("""WITH x AS (SELECT o_orderkey AS run_id, ['failed', 'completed', 'pending'][o_orderkey % 3 + 1] AS status, ['ingesting', 'factorizing', 'other', NULL][o_custkey % 4 + 1] AS res, o_orderkey % 5 <> 0 AS ready FROM orders)
SELECT run_id, CASE WHEN status <> 'failed' THEN NULL WHEN res = 'factorizing' AND ready THEN 'factorizing' WHEN res IN ('ingesting', 'factorizing') THEN 'ingesting' ELSE 'pending' END AS resume_at FROM x""")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), of(("failed", "completed", "pending"), k % 3).alias("status"), of(("ingesting", "factorizing", "other", None), F.col("o_custkey") % 4).alias("resume_from"), (k % 5 != 0).alias("bars_ready"))
    return history.resumed(runs).select("run_id", "resume_at")


@query(f"""WITH {BARS}, d AS (SELECT code, date, close FROM bars), b AS (SELECT code, date, volume / 1000 AS turnover FROM bars WHERE CAST(code AS INTEGER) % 3 <> 0) SELECT d.code, d.date, d.close, {R('turnover')} FROM d LEFT JOIN b ON d.code = b.code AND d.date = b.date""")
def daily_with_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and the daily basics of those that have them (a left join on the source's own key)."""
    b = bars(spark, sf_dir)
    basics = b.where(F.col("code").cast("int") % 3 != 0).select("code", "date", (F.col("volume") / 1000).alias("turnover"))
    return b.join(basics, ["code", "date"], "left").select("code", "date", "close", *r("turnover"))


@query(f"""WITH {INSTRUMENTS}, b AS (SELECT lpad(CAST(p_partkey % 150 AS VARCHAR), 6, '0') AS code, p_partkey AS ord, CASE WHEN p_size = 7 THEN '' ELSE p_brand END AS name, CASE WHEN p_size % 10 = 0 THEN 'Industry board' ELSE p_type END AS type FROM part WHERE p_partkey % 4 <> 2),
  p AS (SELECT code, first(name ORDER BY lower(type) NOT LIKE '%industry%', ord) AS board FROM b WHERE name <> '' GROUP BY code) SELECT i.code, coalesce(p.board, 'UNCLASSIFIED') AS board FROM instruments i LEFT JOIN p ON p.code = i.code""")
def board_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 10 == 0, "Industry board").otherwise(F.col("p_type"))
    boards = table(spark, sf_dir, "part").where("p_partkey % 4 <> 2").select(F.lpad((F.col("p_partkey") % 150).cast("string"), 6, "0").alias("code"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") == 7, "").otherwise(F.col("p_brand")).alias("name"), kind.alias("type"))
    return misc.with_boards(instruments(spark, sf_dir).select("code"), boards)


@query("""WITH s AS (SELECT o_custkey % 10 AS account, CAST(o_orderdate AS DATE) AS "on", o_orderkey AS id FROM orders), c AS (SELECT o_custkey % 10 AS account, min(CAST(o_orderdate AS DATE)) AS f FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 10 <> 3 GROUP BY 1)
SELECT s.account, s."on", s.id FROM s LEFT JOIN c USING (account) WHERE f IS NULL OR s."on" < f""")
def invalidated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("account"), F.to_date("o_orderdate").alias("on"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return writes.invalidate_from(o.select("account", "on", "id"), o.where("o_orderstatus = 'P' and account <> 3"))


@query(f"""WITH {MONTHLY_BARS}, o AS (SELECT code, date AS trade_date, close FROM bars), n AS (SELECT code, trade_date, close * 2 AS close FROM o WHERE CAST(code AS INTEGER) % 2 = 0 AND month(trade_date) % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE trade_date NOT IN (SELECT trade_date FROM n)""")
def replaced_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a stored table that are written again, with fewer rows: whole partitions are replaced, others stay."""
    old = bars(spark, sf_dir, "month").select("code", F.col("date").alias("trade_date"), "close")
    path = writes.scratch(spark, "snapshots")
    writes.replace_date(path, old)
    writes.replace_date(path, old.where((F.col("code").cast("int") % 2 == 0) & (F.month("trade_date") % 2 == 0)).withColumn("close", F.col("close") * 2))
    return spark.read.parquet(path).select("code", "trade_date", "close")


@query("""WITH e AS (SELECT s_suppkey AS s, ['Read timed out', '未获取到数据', 'HTTP 503: no data', 'empty frame', 'boom', ''][s_suppkey % 6 + 1] AS detail, CASE WHEN s_suppkey % 8 = 0 THEN s_name || ' (退市)' ELSE s_name END AS name FROM supplier),
  k AS (SELECT name LIKE '%退市%' OR (NOT regexp_matches(lower(detail), 'timeout|timed out|connect failed|connection|ssl|proxy|network|503|502|429') AND regexp_matches(lower(detail), '未获取到|未找到|no data|not found|empty|查无')) AS skip FROM e)
SELECT count(*) FILTER (WHERE skip) AS skippable, count(*) FILTER (WHERE NOT skip) AS blocking, count(*) FILTER (WHERE NOT skip) / (SELECT count(*) FROM supplier) > 0.02 AS failed FROM k""")
def sync_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = ("Read timed out", "未获取到数据", "HTTP 503: no data", "empty frame", "boom", "")
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    errors = s.select(k.alias("code"), F.element_at(F.array(*map(F.lit, details)), (k % 6 + 1).cast("int")).alias("detail"), F.when(k % 8 == 0, F.concat("s_name", F.lit(" (退市)"))).otherwise(F.col("s_name")).alias("name"))
    return misc.sync_gate(errors, s.count())


@query("""WITH o AS (SELECT c_custkey AS id, c_nationkey AS win, c_name AS v FROM customer), n AS (SELECT c_custkey AS id, c_nationkey AS win, upper(c_name) AS v FROM customer WHERE c_custkey % 3 = 0) SELECT id, win, v FROM o WHERE (id, win) NOT IN (SELECT (id, win) FROM n) UNION ALL SELECT * FROM n UNION ALL SELECT id, win, v || '!' FROM n""")
def replaced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("win"), F.col("c_name").alias("v"))
    new = c.where("id % 3 = 0").withColumn("v", F.upper("v"))
    return writes.replace_keys(c, new.unionByName(new.withColumn("v", F.concat("v", F.lit("!")))), ["id", "win"])


@query("SELECT session, count(*) AS messages FROM (SELECT conv_id AS session FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id FROM conversations WHERE conv_id % 3 <> 0 AND turn = 0) GROUP BY session")
def session_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are appended, then a third of the sessions is deleted."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    left = writes.without_keys(writes.appended(m, m.where("turn = 0")), m.where("session % 3 = 0"), ["session"])
    return left.groupBy("session").agg(F.count("*").alias("messages"))


@query(f"""WITH {BARS}, x AS (SELECT code, date, high, low, close, lag(close) OVER (PARTITION BY code ORDER BY date) AS pc FROM bars), y AS (SELECT code, date, (high - low) * 100 / pc AS amplitude, close - pc AS change FROM x WHERE pc IS NOT NULL) SELECT code, date, {R('amplitude', 'change')} FROM y""")
def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each bar ranged and moved against the close before."""
    from pyspark.sql import Window

    b = bars(spark, sf_dir).withColumn("pc", F.lag("close").over(Window.partitionBy("code").orderBy("date"))).where("pc is not null")
    return b.select("code", "date", amplitude_pct(F.col("high"), F.col("low"), F.col("pc")).alias("amplitude"), (F.col("close") - F.col("pc")).alias("change")).select("code", "date", *r("amplitude", "change"))
