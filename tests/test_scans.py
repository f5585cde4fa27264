"""Scans, pointers and located pages against plain loops, with one key that holds nearly everything."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import history, misc, numbering, portfolio, scan


@pytest.mark.parametrize("n", [1, 7, 1024, 1025, 5000])
def test_recurrence(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([0.0, 1.0, 0.5, -1.0, 2.0]), rnd.random()) for i in range(n)]
    got = {r.n: (r.x_before, r.x) for r in scan.scanned(spark.createDataFrame(rows, "n long, a double, b double").repartition(3), F.col("a"), F.col("b"), "x", bits=3).collect()}
    x = 0.0
    for i, a, b in rows:
        before, x = x, a * x + b
        assert got[i] == (pytest.approx(before, rel=1e-9, abs=1e-9), pytest.approx(x, rel=1e-9, abs=1e-9))


def test_numbers_follow_the_order(spark):
    rows = [(k % 3, k * 7 % 11) for k in range(200)] + [(None, 1)]
    got = sorted((r.n, r.a, r.b) for r in numbering.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.asc_nulls_first("a"), F.desc("b")]).collect())
    assert [g[0] for g in got] == list(range(201)) and [g[1:] for g in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert numbering.numbered(spark.createDataFrame([], "a int, b int"), [F.col("a")]).count() == 0


def fold(events):
    """(held, cost, realized) after each event."""
    q = cost = pnl = 0.0
    out = []
    for kind, n, price, charges, ratio in events:
        if kind == "buy":
            q, cost = q + n, cost + n * price + charges
        elif kind == "sell":
            part = cost * n / q if q > 1e-8 else 0.0
            pnl += n * price - charges - part
            q, cost = (0.0, 0.0) if abs(q - n) < 1e-8 else (q - n, cost - part)
        elif kind == "split":
            q *= ratio
        out.append((q, cost, pnl))
    return out


def test_one_ledger_of_a_million_events(spark):
    n = 1_000_000
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    # every hundredth event sells all, so what is held stays within bounds and costs begin anew
    i = F.col("id") % 100
    kind = F.when(i == 0, "none").when(i == 99, "sell").when(i % 10 == 5, "split").otherwise("buy")
    df = spark.range(n).select(F.lit("one").alias("account"), F.lit("s").alias("symbol"), F.col("id").alias("on"), F.lit(2).alias("priority"), "id", kind.alias("kind"), (h(1, 9) + 1).cast("double").alias("quantity"), (h(2, 90) + 10).cast("double").alias("price"), F.lit(0.5).alias("charges"), F.when(h(3, 2) == 0, 2.0).otherwise(0.5).alias("ratio"))
    got = portfolio.by_average(df, ["account", "symbol"], ["on", "priority", "id"])
    rows = got.orderBy("id").select("kind", "quantity", "price", "charges", "ratio", "held", "cost", "part").toPandas()
    want = np.array(fold(rows[["kind", "quantity", "price", "charges", "ratio"]].itertuples(index=False, name=None)))
    assert len(rows) == n and np.allclose(rows["held"], want[:, 0], rtol=1e-9, atol=1e-6) and np.allclose(rows["cost"], want[:, 1], rtol=1e-7, atol=1e-4)
    sold = rows["kind"] == "sell"
    assert abs((rows["quantity"] * rows["price"] - 0.5 - rows["part"])[sold].sum() - want[-1, 2]) < 1e-6 * abs(want[-1, 2])


def test_many_ledgers_by_average(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), "s", dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(40)), 2, i, rnd.choice(["buy", "buy", "sell", "split", "deposit", "withdrawal", "dividend"]), float(rnd.randrange(1, 9)), float(rnd.randrange(1, 5)), 0.25, rnd.choice([2.0, 0.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "account string, symbol string, on date, priority int, id int, kind string, quantity double, price double, charges double, ratio double")
    got = {r.account: r for r in misc.replay(df).collect()}
    assert set(got) == {"a", "b", None}
    for account, r in got.items():
        mine = sorted((x for x in rows if x[0] == account), key=lambda x: (x[2], x[3], x[4]))
        states = fold([x[5:] for x in mine])
        cash, q = 0.0, 0.0
        for (*_, kind, n, price, charges, _), (after, *_) in zip(mine, states):
            cash += {"buy": -n * price - charges, "sell": n * price - charges, "dividend": q * price, "deposit": n, "withdrawal": -n}.get(kind, 0.0)
            q = after
        assert (r.quantity, r.cost, r.realized_pnl, r.cash) == tuple(pytest.approx(x, abs=1e-6) for x in (*states[-1], cash))


def test_large_ledgers_are_scanned_with_the_same_result(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), "s", f"2024-01-{rnd.randrange(1, 29):02d}", i, rnd.choice(["buy", "buy", "sell"]), float(rnd.randrange(1, 9)), 2.0, 0.25, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "account string, symbol string, date string, id int, side string, quantity double, price double, fee double, tax double")
    folded = {r.account: tuple(r)[2:] for r in portfolio.average_cost(df).collect()}
    monkeypatch.setattr(portfolio, "MOST_FOLDED", 50)
    got = {r.account: tuple(r)[2:] for r in portfolio.average_cost(df).collect()}
    assert len(got) == 3 and all(got[k] == pytest.approx(folded[k], abs=1e-9) for k in folded)


def test_requests_in_flight(spark):
    rnd = random.Random(8)
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = []
    for i in range(1500):
        at = rnd.randrange(3000)
        rows.append((i, rnd.choice(["hot"] * 9 + ["a", "b", None]), t(at), None if rnd.random() < 0.001 else t(at + rnd.choice([0, 1, 5, 60, 300]))))
    got = {r.id: r.accepted for r in history.active_tasks(spark.createDataFrame(rows, "id int, code string, created_at timestamp, finished_at timestamp").repartition(4)).collect()}
    until, want = {}, {}
    for i, code, at, end in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = code not in until or at >= until[code]
        if want[i]:
            until[code] = end or dt.datetime.max
    assert got == want


def test_deep_page_reads_one_range(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("price"), F.repeat(F.lit("x"), 20).alias("rest"))
        order = sorted(((r.price, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
        page = history.page_with_total(df, [F.desc("price"), F.col("id")], 10_000, 9)
        assert [(r.price, r.id, r.total) for r in page.collect()] == [(*x, 100_000) for x in order[9999 * 9 : 10_000 * 9]]
        scans = [m for m in page._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in m]
        assert scans and all("GreaterThanOrEqual(_i" in x or "_i#" in x and ">=" in x or "..._i," in x for x in scans)  # a file holds one range, and its footer tells which
        assert history.page_with_total(df, [F.col("id")], 20_000, 9).count() == 0
        last = history.page_with_total(df, [F.col("id")], 1, 3).collect()
        assert [r.id for r in last] == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
