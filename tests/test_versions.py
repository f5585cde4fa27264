"""The log of versions: batches that run again, writers that die, readers that stay, bytes that a batch writes; the rule of intraday bars."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger
from marketloom.sources import versions
from marketloom.sources.versions import Change, Conflict, Versions
from marketloom.streaming import streams

QUOTE = "code string, date date, at int, price double, open double, pre_close double, high double, low double, volume double, amount double, pct_chg double"
BAR = "code string, date date, open double, high double, low double, close double, volume double, amount double, pct_chg double"
D = dt.date(2024, 3, 1)


def sizes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def quote(code, date, at, price, open_=None, pre=None, high=None, low=None, volume=None, amount=None, pct=None):
    return (code, date, at, price, open_, pre, high, low, volume, amount, pct)


def bars_of(store, **k):
    return {(r.code, r.date): tuple(r)[2:] for r in store.read("bars", **k).collect()}


@pytest.fixture()
def store(spark, tmp_path):
    s = Versions(spark, f"file://{tmp_path}/store")
    # five years of days, so that a batch of one day touches one month of sixty
    rows = spark.range(1800 * 20).select(F.format_string("%06d", F.col("id") % 20).alias("code"), F.date_add(F.lit(D), -(F.col("id") / 20).cast("int") - 1).alias("date"), *(F.lit(x).alias(c) for c, x in zip(streams.BAR, (1.0, 2.0, 0.5, 1.7, 100.0, 170.0, 0.1))))
    streams.store_bars(s, rows)
    return s


def test_rule_of_intraday_bars(spark, store):
    y, old = D - dt.timedelta(1), (1.0, 2.0, 0.5, 1.7, 100.0, 170.0, 0.1)
    rows = [quote("000001", D, 1, 1.5), quote("000002", D, 1, 1.5, open_=0.0, pre=1.2, high=1.6, low=1.4, volume=5.0, amount=8.0, pct=-3.0), quote("000003", y, 1, 1.9), quote("000004", D - dt.timedelta(400), 1, 1.8, volume=0.0, amount=9.0), quote("000005", D, 1, 0.0), quote("none", D, 1, 1.0)]
    rows += [quote("000006", D, 1, 1.1), quote("000006", D, 2, 1.2, high=3.0), quote("000006", D + dt.timedelta(3), 1, 1.3)]
    assert streams.merge_quotes(store, spark.createDataFrame(rows, QUOTE), 0) == 1
    got = bars_of(store)
    assert got["000001", D] == (1.7, 1.5, 1.5, 1.5, 0.0, 0.0, 0.0)  # the close before, the price, the price
    assert got["000002", D] == (1.2, 1.6, 1.4, 1.5, 5.0, 8.0, -3.0)
    assert got["000003", y] == (1.7, 1.9, 1.9, 1.9, 100.0, 170.0, 0.1) and ("000003", D) not in got
    assert got["000004", y] == (1.7, 1.8, 1.8, 1.8, 100.0, 9.0, 0.1)  # a bar dated later than the quote takes it
    assert ("000005", D) not in got and ("none", D) not in got and got["000005", y] == old
    assert got["000006", D] == (1.7, 3.0, 1.2, 1.2, 0.0, 0.0, 0.0) and got["000006", D + dt.timedelta(3)][:4] == (1.2, 1.3, 1.3, 1.3)
    assert len(got) == 36_000 + 4


def test_batch_again_is_nothing_and_readers_stay(spark, store):
    before = bars_of(store)
    q = spark.createDataFrame([quote("000001", D, 1, 1.5)], QUOTE)
    assert streams.merge_quotes(store, q, 0) == 1 and streams.merge_quotes(store, q, 0) == 1 and store.latest() == 1
    assert bars_of(store, version=0) == before and len(bars_of(store)) == len(before) + 1
    other = spark.createDataFrame([quote("000001", D, 1, 9.0)], QUOTE)
    assert streams.merge_quotes(store, other, 0) == 1 and bars_of(store)["000001", D][3] == 1.5


def test_bytes_of_a_batch(spark, store, tmp_path):
    whole = sizes(tmp_path)
    streams.merge_quotes(store, spark.createDataFrame([quote("000001", D, 1, 1.5)], QUOTE), 0)
    streams.merge_quotes(store, spark.createDataFrame([quote("000001", D, 2, 1.6)], QUOTE), 1)
    assert sizes(tmp_path) - whole < whole / 10
    assert len(store.version().tables["bars"]) == len(store.version(0).tables["bars"]) + 1
    assert store.vacuum(keep=1) > 0 and bars_of(store)["000001", D][3] == 1.6 and len(bars_of(store)) == 36_001


def test_stream_stopped_and_started_again(spark, store, tmp_path):
    def run(fail=False):
        stream = spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if not fail:
            return streams.upsert_stream(stream, store, str(tmp_path / "cp"))

        def merge(batch, number):
            streams.merge_quotes(store, batch, number)
            raise RuntimeError("killed after the commit, before the checkpoint")

        with pytest.raises(Exception, match="killed"):
            stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    put = lambda *rows: spark.createDataFrame(list(rows), QUOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(quote("000001", D, 1, 1.5))
    run(fail=True)
    assert store.latest() == 1
    run()  # the same batch again
    assert store.latest() == 1 and bars_of(store)["000001", D][3] == 1.5
    put(quote("000001", D, 2, 1.6), quote("000002", D, 2, 1.4))
    run()
    assert store.latest() == 2 and bars_of(store)["000001", D][:4] == (1.5, 1.6, 1.6, 1.6) and bars_of(store)["000001", D][3] == 1.6


def part(df, column="account"):
    return df.withColumn(versions.PART, versions.bucket(column, 4))


def accounts(spark, k):
    return spark.createDataFrame([(a, "fifo", f"s{k}", float(k)) for a in range(10)], "account long, method string, symbol string, quantity double")


def refreshed(spark, store, k, some):
    a = accounts(spark, k).where(some)
    return ledger.refresh(store, a.select("account", "method"), a.where("account <> 4"), a, a.select("account", "method", "quantity").withColumn("date", F.lit(D)))


def seen(store, version=None):
    v = store.version(version)
    return {t: sorted((r.account, r.quantity) for r in store.read(t, v).collect()) for t in ("positions", "lots", "snapshots")}


def test_writer_killed_between_tables(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"file://{tmp_path}")
    refreshed(spark, store, 1, "true")
    before = seen(store)
    assert len(before["positions"]) == 9 and len(before["lots"]) == len(before["snapshots"]) == 10
    for step in range(3):  # dies while it writes the second table, the third, or before the entry
        written, real = [], Versions._files

        def files(self):
            if len(written) > step:
                raise RuntimeError("killed")
            written.append(1)
            return real(self)

        at = store.version()
        monkeypatch.setattr(Versions, "version", lambda self, number=None: at)
        monkeypatch.setattr(Versions, "_files", files)
        with pytest.raises(RuntimeError, match="killed"):
            refreshed(spark, store, 2, "account % 2 = 0")
        monkeypatch.undo()
        assert store.latest() == 0 and seen(store) == before
    refreshed(spark, store, 2, "account % 2 = 0")
    now = seen(store)
    assert now["lots"] == [(a, 2.0 - a % 2) for a in range(10)] == now["snapshots"] and now["positions"] == [x for x in now["lots"] if x[0] != 4]
    assert seen(store, 0) == before


def test_account_without_positions_is_emptied(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}")
    refreshed(spark, store, 1, "true")
    none = accounts(spark, 1).where("false")
    ledger.refresh(store, accounts(spark, 1).where("account = 3").select("account", "method"), none, none, none.select("account", "method", "quantity").withColumn("date", F.lit(D)))
    assert 3 not in dict(seen(store)["positions"]) and 3 not in dict(seen(store)["lots"]) and 3 in dict(seen(store)["snapshots"])


def test_two_writers(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}")
    rows = part(spark.range(100).withColumnRenamed("id", "account"))
    every = versions.touched(rows, F.col(versions.PART))
    store.commit({"t": Change(rows, every)})
    base = store.version()
    one = lambda p: Change(rows.where(F.col(versions.PART) == p).limit(1), [p])
    assert store.commit({"t": one(every[0])}, base) == 1
    assert store.commit({"t": one(every[1])}, base) == 2  # another partition: both stay
    gone = sum(r["count"] - 1 for r in rows.groupBy(versions.PART).count().collect() if r[0] in every[:2])
    assert store.read("t").count() == 100 - gone
    with pytest.raises(Conflict):
        store.commit({"t": one(every[0])}, base)
    with pytest.raises(ValueError, match="doesn't name"):
        store.commit({"t": Change(rows, every[:1])})
    assert store.latest() == 2 and store.read("t", parts=[]).count() == 0


def test_late_news_and_dropped_state(spark, tmp_path):
    """Unmatched analyses come once the watermark is past them, news that are late within the delay still match, and state goes."""
    t = lambda h: dt.datetime(2024, 1, 10) + dt.timedelta(hours=h)
    a_schema, n_schema = "id int, code string, created_at timestamp", "news_id int, code string, fetched_at timestamp, published date"
    day = lambda h: t(h).date()
    steps = [
        ([(1, "x", t(0)), (2, "y", t(0)), (3, "x", t(1))], [(10, "x", t(5), day(0)), (11, "x", t(7), day(0)), (12, "x", t(3), day(-200)), (13, "x", t(2), None)]),
        ([(4, "z", t(20))], [(14, "y", t(-4), day(0)), (15, "z", t(26), day(20))]),  # news of y come late, and still match
        ([(5, "z", t(200))], [(16, "z", t(200), day(200))]),
        ([(6, "z", t(201))], [(17, "x", t(1), day(0)), (18, "q", t(201), day(200))]),  # far too late for analysis 1
    ]
    progress = []
    for k, (a, n) in enumerate(steps):
        spark.createDataFrame(a, a_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        spark.createDataFrame(n, n_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
        joined = streams.news_of_analyses(spark.readStream.schema(a_schema).parquet(str(tmp_path / "a")), spark.readStream.schema(n_schema).parquet(str(tmp_path / "n")), delay="12 hours")
        q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1:]
    got = sorted((r.id, r.news_id or 0) for r in spark.read.schema("id int, created_at timestamp, news_id int, published date").parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 10), (2, 14), (3, 10), (3, 11), (4, 15), (5, 16), (6, 16)]
    assert progress[-1] <= 6  # of fourteen rows
