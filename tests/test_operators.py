"""Literal cases on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import advice, codes, text
from marketloom.operators import backtest, indicators, logs, market, portfolio, screening
from marketloom.operators.asof import asof
from marketloom.sources import writes
from marketloom.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def bars(spark, closes, code="600519", volumes=None):
    rows = [(code, d, c, c * 1.01, c * 0.99, c, float((volumes or [100] * len(closes))[i]), c * 100) for i, (d, c) in enumerate(zip(days(len(closes)), map(float, closes)))]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")


@pytest.mark.parametrize(
    "said, expected, position",
    [("买入", "up", "long"), ("strong buy", "up", "long"), ("卖出", "down", "cash"), ("hold", "not_down", "long"), ("观望", "flat", "cash"), ("do not sell", "flat", "cash"), ("不要卖出", "flat", "cash"), ("wait for a dip then buy", "flat", "cash"), (None, "flat", "cash"), ("", "flat", "cash")],
)
def test_advice(spark, said, expected, position):
    row = spark.createDataFrame([(said,)], "x string").select(advice.direction(F.col("x")), advice.position(F.col("x"))).first()
    assert tuple(row) == (expected, position)


@pytest.mark.parametrize("plan, cash", [("10派3元(含税)", 0.3), ("每10股派发2.5元", 0.25), ("每股派0.8元", 0.8), ("10送5", None)])
def test_dividend_plans(spark, plan, cash):
    assert one(spark, text.dividend_per_share, plan) == cash


@pytest.mark.parametrize("said, price", [("1,234.5", 1234.5), ("理想买入点：125元（MA20 附近）", 125.0), ("止损: MA5 下方 98.5 元", 98.5), ("暂无", None), ("约 12.5 (MA10)", 12.5), ("(18.5)", 18.5), ("买入：1，234元", 1234.0), ("0元", 0.0), ("18.5-19.2元", 19.2), ("MA5", None), (" - ", None), ("-3", -3.0), ("目标：18元，止损：看MA10", 18.0)])
def test_price_points(spark, said, price):
    assert one(spark, text.price_point, said) == price


@pytest.mark.parametrize("raw, code, market_", [("sh600519", "600519", "cn"), ("000001.SZ", "000001", "cn"), ("700.hk", "HK00700", "hk"), ("hk700", "HK00700", "hk"), ("aapl", "aapl", "us"), ("SPX", "SPX", "us-index"), ("bj430047", "430047", "cn")])
def test_codes(spark, raw, code, market_):
    assert one(spark, codes.normalize, raw) == code
    assert one(spark, codes.market, raw) == market_


def test_published(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    say = lambda x: one(spark, lambda c: text.published(c, now), x)
    assert say("3 days ago") == dt.date(2024, 3, 7)
    assert say("2周前") == dt.date(2024, 2, 25)
    assert say("13 hours ago") == dt.date(2024, 3, 9)
    assert say("2024年1月5日") == dt.date(2024, 1, 5)
    assert say("1704067200") == dt.date(2024, 1, 1)
    assert say("2024-02-03T04:05:06Z") == dt.date(2024, 2, 3)
    assert say("someday") is None and say(None) is None
    for said in ("Mon, 02 Jan 2023 23:04:05 GMT", "January 2, 2023", "2 January 2023", "Jan 2nd, 2023", "2023/01/02 10:20", "2023.01.02", "2023-1-2", "发布于2023年1月2日", "2023-01-03T01:00:00+08:00", "Tue, 3 Jan 2023 01:00 +0800", "20230102", "Jan 2, 2023 09:00 PST"):
        assert say(said) == dt.date(2023, 1, 2), said
    assert say("前天") == dt.date(2024, 3, 8) and say("3月前") == dt.date(2023, 12, 11) and say("5 mins ago") == say("now") == dt.date(2024, 3, 10)
    assert say("2023-02-31") is None and say("Feb 31, 2023") is None and say("Jan 2 2023") is None


@pytest.mark.parametrize("asked, code", [("600519怎么样", "600519"), ("hk00700 ok", "HK00700"), ("BUY AAPL", ""), ("AAPL please", "AAPL"), ("brk.b", "BRK.B"), ("tell me", ""), ("研究 the tsla", "TSLA"), ("hello", "")])
def test_code_of_a_question(spark, asked, code):
    assert one(spark, text.code_in, asked) == code


def test_chunks_keep_letters_whole(spark):
    said = "é" * 25 + "\n" + "abc"
    got = text.cut_bytes(said, 10)
    assert all(len(x.encode()) <= 10 for x in got) and "".join(got).replace("\n", "") == said.replace("\n", "")
    assert one(spark, lambda c: text.chunks(c, 10), said) == got
    paged = one(spark, lambda c: text.chunks(c, 10 + text.PAGE_MARK_BYTES, page_marks=True), said)
    assert paged == [f"{x}\n\n📄 {i}/{len(got)}" for i, x in enumerate(got, 1)]


def test_ema_matches_recursion(spark):
    closes = [10 + (i * 37 % 11) / 3 for i in range(2300)]  # more than two blocks
    rows = indicators.ema(bars(spark, closes), "close", 9, "y").orderBy("date").select("y").collect()
    y = closes[0]
    for i, c in enumerate(closes):
        y = c if i == 0 else 0.2 * c + 0.8 * y
        assert abs(rows[i][0] - y) < 1e-9


def test_rsi(spark):
    rows = [r[0] for r in indicators.rsi(bars(spark, [10, 11, 12, 13, 14, 15, 16, 16, 15]), (6,)).orderBy("date").select("rsi6").collect()]
    assert rows[:5] == [50.0] * 5 and rows[5] == 100.0 and rows[6] == 100.0 and rows[8] < 100
    flat = [r[0] for r in indicators.rsi(bars(spark, [5] * 8), (6,)).select("rsi6").collect()]
    assert flat == [50.0] * 8


def test_ma60_falls_back_for_short_series(spark):
    r = indicators.latest(indicators.moving_averages(bars(spark, range(1, 31)))).first()
    assert r.ma60 == r.ma20 == sum(range(11, 31)) / 20


def trade_rows(spark, rows):
    return spark.createDataFrame([(1, "A", dt.date(2024, 1, d), i, side, float(q), float(p), float(fee), float(tax)) for i, (d, side, q, p, fee, tax) in enumerate(rows)], "account int, symbol string, date date, id int, side string, quantity double, price double, fee double, tax double")


def test_fifo_and_average_cost(spark):
    t = trade_rows(spark, [(1, "buy", 100, 10, 10, 0), (2, "buy", 100, 20, 10, 0), (3, "sell", 150, 30, 10, 5)])
    assert portfolio.realized(t).first().realized_pnl == pytest.approx(2470)
    held = portfolio.positions(t).first()
    assert held.quantity == 50 and 25 * 50 - held.cost == pytest.approx(245)
    avg = portfolio.average_cost(t).first()
    assert avg.realized_pnl == pytest.approx(2220) and 25 * 50 - avg.cost == pytest.approx(495)


def test_oversell(spark):
    t = trade_rows(spark, [(1, "buy", 10, 1, 0, 0), (2, "sell", 20, 1, 0, 0)])
    assert [r.oversold for r in portfolio.sell_validation(t).orderBy("id").collect()] == [False, True]


def test_fx(spark):
    rates = spark.createDataFrame([("USD", "CNY", dt.date(2024, 1, 1), 7.0, False), ("CNY", "HKD", dt.date(2024, 1, 1), 2.0, False)], "from_currency string, to_currency string, rate_date date, rate double, is_stale boolean")
    rows = [("USD", 100.0), ("HKD", 100.0), ("EUR", 100.0), ("CNY", 100.0), ("EUR", 0.0)]
    amounts = spark.createDataFrame([(c, dt.date(2024, 2, 1), a) for c, a in rows], "currency string, on date, amount double")
    got = {(r.currency, r.amount): (r.converted, r.stale) for r in portfolio.to_currency(amounts, rates).collect()}
    assert got == {("USD", 100.0): (700.0, False), ("HKD", 100.0): (50.0, False), ("EUR", 100.0): (100.0, True), ("CNY", 100.0): (100.0, False), ("EUR", 0.0): (0.0, False)}


def forward(spark, start, ahead):
    rows = [("A", days(1)[0], start, start, start, start, 1.0, 1.0)] + [("A", d, c, h, l, c, 1.0, 1.0) for d, (h, l, c) in zip(days(len(ahead) + 1)[1:], ahead)]
    b = spark.createDataFrame([tuple(map(lambda x: float(x) if isinstance(x, int) else x, r)) for r in rows], "code string, date date, open double, high double, low double, close double, volume double, amount double")
    a = spark.createDataFrame([(1, "A", days(1)[0], "买入")], "id int, code string, date date, advice string")
    return b, a


def test_backtest_take_profit(spark):
    b, a = forward(spark, 100, [(111, 100, 105), (108, 103, 106), (109, 104, 107)])
    r = backtest.evaluate(a, b, days=3).first()
    assert (r.eval_status, r.position, r.direction, r.end, r.outcome, r.first_hit, r.first_hit_days, r.hit_stop_loss) == ("completed", "long", "up", 107.0, "win", "take_profit", 1, False)
    assert r.stock_return_pct == pytest.approx(7)


def test_backtest_ambiguous_and_short(spark):
    b, a = forward(spark, 100, [(111, 94, 100)])
    r = backtest.evaluate(a, b, days=1).first()
    assert r.first_hit == "ambiguous" and r.simulated_return_pct == pytest.approx(-5)
    assert backtest.evaluate(a, b, days=5).first().eval_status == "insufficient_data"


def test_asof_takes_the_last_not_after(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 7, "c")], "k string, t int, v string")
    got = {(r.k, r.t): r.m and r.m.v for r in asof(left, right, ["k"], "t", "t", "m").collect()}
    assert got == {("k", 5): "b", ("k", 1): None, ("z", 9): None}


def test_screen(spark):
    row = lambda code, st=False, amount=1e8, vr=1.5, br=1.01: (code, st, 500, amount, vr, br, 12.0, 11.0, 10.5, 10.0)
    snap = spark.createDataFrame([row("600001", br=1.02, vr=1.8), row("600002", br=0.99, vr=1.25), row("600003", amount=1e6), row("600004", st=True)], "code string, is_st boolean, days_since_listed int, avg_amount double, volume_ratio double, breakout_ratio double, close double, ma5 double, ma10 double, ma20 double")
    got = {r.code: r for r in screening.screen(snap, 120, 5e7, 1.2).collect()}
    assert got["600001"].rank == 1 and got["600001"].rule_score == pytest.approx(121.8)
    assert got["600002"].rank == 2 and got["600003"].reasons == ["liquidity_below_threshold"] and got["600004"].reasons == ["st_filtered"]


def test_final_rank_sorts_before_it_limits(spark):
    c = spark.createDataFrame([("a", 80.0), ("b", 79.0), ("c", 78.0)], "code string, rule_score double")
    advice_ = spark.createDataFrame([("c", "buy")], "code string, advice string")
    news = spark.createDataFrame([], "code string")
    assert [(r.code, r.final_rank) for r in screening.final_rank(c, advice_, news, 1).collect()] == [("c", 1)]


def test_freshness(spark):
    today = dt.date(2024, 3, 10)
    rows = [(0, today - dt.timedelta(30)), (1, None), (2, today + dt.timedelta(2)), (3, today + dt.timedelta(1)), (4, today)]
    news = spark.createDataFrame(rows, "ord int, published date")
    assert [r.ord for r in logs.fresh_news(news, F.lit(today), 7, 10).collect()] == [3, 4]
    assert {r.ord for r in logs.fresh_news(news, F.lit(today), 7, keep_unknown=True).collect()} == {1, 3, 4}


def test_breadth_handles_strings_and_suspension(spark):
    q = spark.createDataFrame([("600000", "x", "11.00", "10.00", "1e8"), ("300001", "y", "-", "5", "1e8"), ("830001", "z", "7", "10", "0"), ("000001", "ST w", "9.5", "10", None)], "code string, name string, last string, prev_close string, amount string")
    r = market.breadth(q).first()
    assert (r.up, r.down, r.limit_up, r.limit_down, r.total_amount) == (1, 1, 1, 1, 2.0)


def test_status_changes(spark):
    runs = spark.createDataFrame([("a", "pending"), ("b", "completed"), ("c", "screening")], "run_id string, status string")
    changes = spark.createDataFrame([("a", "completed"), ("b", "screening"), ("c", "completed")], "run_id string, to string")
    assert {r.run_id: (r.status, r.accepted) for r in writes.change_status(runs, changes).collect()} == {"a": ("pending", False), "b": ("completed", False), "c": ("completed", True)}


def test_replace_date_keeps_other_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "code string, trade_date string")
    rows(("a", "d1"), ("b", "d1"), ("a", "d2")).write.partitionBy("trade_date").parquet(path)
    writes.replace_date(path, rows(("c", "d1")))
    assert sorted(r.code for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_store_swaps(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        writes.store(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_breaker(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), False), ("a", t(1), False), ("a", t(2), False), ("a", t(10), True), ("a", t(310), True), ("tick", t(90_000), True)]
    spark.createDataFrame(rows, "source string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("source string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    got = [(r.state, r.ts) for r in streams.drained("breaker_test", streams.breaker(s), str(tmp_path / "cp")).orderBy("ts").collect()]
    assert got == [("open", t(2)), ("closed", t(310))]


def test_breaker_with_many_and_late_calls(spark, tmp_path):
    """Most calls are one source's, in any order; a second batch brings some late ones, and a call too late is passed over."""
    begin, n = dt.datetime(2024, 1, 1), 60_000
    calls = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.timestamp_micros(F.lit(1704067200 * 1_000_000) + F.pmod(F.xxhash64("id"), F.lit(200_000)) * 1_000_000).alias("ts"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("ok"))
    schema, folder = calls.schema, str(tmp_path / "in")
    first = calls.where("ts < '2024-01-02 06:00:00'").repartition(3)
    late = [("a", begin + dt.timedelta(hours=29, minutes=55, seconds=k), False) for k in range(5)]
    rest = calls.where("ts >= '2024-01-02 06:00:00'").union(spark.createDataFrame([*late, ("a", begin, True), ("tick", begin + dt.timedelta(days=9), True)], schema))
    for k, part in enumerate((first, rest)):
        part.write.mode("append").parquet(folder)
        got = streams.drained(f"breaker_{k}", streams.breaker(spark.readStream.schema(schema).parquet(folder)), str(tmp_path / "cp")).where("source <> 'tick'")
    rows = [(r.source, r.ts, r.ok) for r in first.collect() + rest.where("source <> 'tick' and ts <> '2024-01-01 00:00:00'").collect()]
    want = []
    for source in ("a", "b"):
        count, opened = 0, None
        for _, ts, ok in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], not r[2])):
            if opened is not None and (ts - opened).total_seconds() < 300:
                continue
            if ok:
                want += [(source, ts, "closed")] if opened is not None else []
                count, opened = 0, None
            else:
                count += 1
                if opened is not None or count >= 3:
                    want.append((source, ts, "open"))
                    opened = ts
    assert sorted((r.source, r.ts, r.state) for r in got.collect()) == sorted(want) and len(want) > 200


def test_replay_with_dividend_and_split(spark):
    from marketloom.operators import misc

    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    kind = "account int, on date, id int, kind string, quantity double, price double, charges double, ratio double"
    cash = spark.createDataFrame([(1, d[0], 1, "deposit", 10000.0, None, None, None)], kind)
    acts = spark.createDataFrame([(1, d[2], 1, "dividend", None, 1.0, None, None), (1, d[3], 2, "split", None, None, None, 2.0)], kind)
    trades = spark.createDataFrame([(1, d[1], 1, "buy", 100.0, 10.0, 0.0, None)], kind)
    r = misc.replay(misc.ledger(cash, acts, trades), ["account"]).first()
    assert (r.cash, r.quantity, r.cost) == (9100.0, 200.0, 1000.0)
    same_day = spark.createDataFrame([(1, d[1], 1, "dividend", None, 1.0, None, None)], kind)
    assert misc.replay(misc.ledger(cash.withColumn("quantity", F.lit(2000.0)), same_day, trades), ["account"]).first().cash == 1000.0


def test_replay_reads_every_event(spark, tmp_path):
    from marketloom.plans import registry

    rows = [(i, (i * 7) % 50, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 37) % 900), float(i % 83)) for i in (*range(0, 300), *range(3990, 4600))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i, user, _, value in sorted(rows, key=lambda x: (x[2].date(), (0, 1, 1, 2, 2)[x[0] % 5], x[0])):
        q, cost, cash = want.get(user % 20, (0.0, 0.0, 0.0))
        n = value + 1
        steps = [(q, cost, cash + n), (q, cost, cash + q * 0.01), (q * 1.001, cost, cash), *[(q + n, cost + n * 2 + 0.5, cash - n * 2 - 0.5)] * 2]
        want[user % 20] = steps[i % 5]
    got = {r.account: (r.quantity, r.cost, r.cash) for r in registry.queries()["portfolio_replay"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 0.011 for k in want for a, b in zip(got[k], want[k]))


def test_modes_only_loosen_or_tighten():
    from marketloom.operators import misc

    base = {"candidate_limit": 30, "min_volume_ratio": 1.2, "x": 1}
    assert misc.resolve_mode("aggressive", base, {"candidate_limit": 50, "min_volume_ratio": 1.0}) == {"candidate_limit": 50, "min_volume_ratio": 1.0, "x": 1}
    assert misc.resolve_mode("quality", base, {"candidate_limit": 50, "min_volume_ratio": 1.5}) == {"candidate_limit": 30, "min_volume_ratio": 1.5, "x": 1}
    assert misc.resolve_mode("balanced", base, {"candidate_limit": 50}) == base
