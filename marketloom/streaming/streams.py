"""Streams. The inventory's own constructs are keyed upserts, repeats by key and a circuit breaker; windows and watermarks
over event time are extensions of this engine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from marketloom.functions.shipping import ship
from marketloom.sources import versions, writes


def dedup(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark is past them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, ts: str, width: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of `value` in tumbling windows of event time."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Seconds of event time that are put in order together.
SPAN = 3600
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Breaker(StatefulProcessor):
    """Calls wait in the state, by spans of event time, until the watermark has passed their span; a timer for each span then takes them in
    order. So a task holds one Arrow batch or one span of one source, however many calls a batch brings, and late ones find their place."""

    def __init__(self, failures: int, cooldown_s: int):
        self.failures, self.cooldown_s = failures, cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "count long, opened long")
        self.parts = handle.getMapState("parts", "span long", "n long")
        self.calls = handle.getMapState("calls", "span long, part long", "calls binary")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for some in rows:
            at = some["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            packed = at * 2 + ~some["ok"].to_numpy(bool)  # failures after successes of the same moment
            spans = at // (SPAN * 1_000_000)
            for span in np.unique(spans):
                k = (int(span),)
                n = self.parts.getValue(k)[0] if self.parts.containsKey(k) else 0
                self.calls.updateValue((int(span), n), (packed[spans == span].tobytes(),))
                self.parts.updateValue(k, (n + 1,))
                if not n:
                    self.handle.registerTimer((int(span) + 1) * SPAN * 1000)
        yield self._told([])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        span = expiredTimerInfo.getExpiryTimeInMs() // (SPAN * 1000) - 1
        count, opened = self.state.get() if self.state.exists() else (0, 0)
        n = self.parts.getValue((span,))[0]
        calls = np.sort(np.concatenate([np.frombuffer(bytes(self.calls.getValue((span, i))[0]), np.int64) for i in range(n)]))
        out: list[tuple] = []
        for call in calls.tolist():
            us, failed = divmod(call, 2)
            now = us // 1_000_000
            if opened and now - opened < self.cooldown_s:
                continue  # calls are refused
            if failed:
                count += 1
                if opened or count >= self.failures:
                    out.append((key[0], us, "open"))
                    opened = now
            else:
                if opened:
                    out.append((key[0], us, "closed"))
                count, opened = 0, 0
        for i in range(n):
            self.calls.removeKey((span, i))
        self.parts.removeKey((span,))
        if count or opened:
            self.state.update((count, opened))
        else:
            self.state.clear()  # a source without failures leaves nothing
        yield self._told(out)

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        text = lambda k: pd.Series([r[k] for r in rows], dtype=object)
        return pd.DataFrame({"source": text(0), "ts": pd.Series([r[1] for r in rows], dtype="int64").astype("datetime64[us]"), "state": text(2)})

    def close(self) -> None:
        pass


def breaker(stream: DataFrame, failures: int = 3, cooldown_s: int = 300, delay: str = "10 minutes") -> DataFrame:
    """stream: source, ts, ok. A row each time a source's breaker opens or closes: source, ts, state, once the watermark is past it. It opens
    after so many failures in a row and half-opens after the cooldown; a success then closes it, a failure opens it again. Times
    are taken in UTC."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    calls = stream.select("source", "ts", "ok").withWatermark("ts", delay).groupBy("source")
    return calls.transformWithStateInPandas(_Breaker(failures, cooldown_s), "source string, ts timestamp, state string", "Append", "EventTime")


def news_of_analyses(analyses: DataFrame, news: DataFrame, hours: int = 6, window_days: int = 3, delay: str = "1 day") -> DataFrame:
    """analyses: id, code, created_at. news: news_id, code, fetched_at, published. The news of each analysis's code that were fetched within
    `hours` of it, before or after, as either arrives: id, created_at, news_id, published, with news_id null for an analysis without any, once
    the watermark is past its time. Rows that the other side can't meet any more are dropped from the state. News published outside
    the analysis's window don't count. An analysis waits in one cell of twice `hours`, news in the two that they reach, if an analysis of
    that cell can count them, so a row is held against its own cell only, not against all rows of its code."""
    width, at = max(1, 2 * hours) * 3600, F.unix_timestamp("fetched_at")
    day_of = lambda second: F.to_date(F.timestamp_seconds(second))
    meets = lambda k: F.col("published").between(F.date_sub(day_of(k * width), max(0, window_days - 1)), F.date_add(day_of((k + 1) * width - 1), 1))
    cells = F.filter(F.array_distinct(F.array(*(F.floor((at + k * hours * 3600) / width) for k in (-1, 1)))), meets)
    a = analyses.withColumn("_cell", F.floor(F.unix_timestamp("created_at") / width)).withWatermark("created_at", delay).alias("a")
    n = news.withColumn("_cell", F.explode(cells)).withWatermark("fetched_at", delay).alias("n")
    apart = F.expr(f"n.fetched_at BETWEEN a.created_at - INTERVAL {hours} HOURS AND a.created_at + INTERVAL {hours} HOURS")
    day = F.to_date("a.created_at")
    around = F.col("n.published").between(F.date_sub(day, max(0, window_days - 1)), F.date_add(day, 1))
    return a.join(n, (F.col("a.code") == F.col("n.code")) & (F.col("a._cell") == F.col("n._cell")) & apart & around, "leftOuter").select("a.id", "a.created_at", "n.news_id", "n.published")


BAR = ("open", "high", "low", "close", "volume", "amount", "pct_chg")


def intraday(quotes: DataFrame, last: DataFrame) -> DataFrame:
    """Bars that quotes make of what is stored. quotes: code, date, price, open, pre_close, high, low, volume, amount, pct_chg, one a code and day.
    last: code, date and BAR of the newest bar of each code. The newest bar takes a quote of its day or an earlier one, and a later quote begins
    a bar. An open of 0 or null is the close before; a missing high or low is the price; volume, amount and change stay, or are 0 in a new
    bar. A quote without a price above 0, or of a code without bars, is passed over."""
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    kept = F.struct(F.col("date").alias("day"), *BAR).alias("b")
    both = quotes.where("price > 0").join(last.select("code", kept), "code")
    w = Window.partitionBy("code").orderBy("date")
    both = both.withColumn("before", F.coalesce(F.lag("price").over(w), F.col("b.close")))
    old = F.col("date") <= F.col("b.day")
    rows = both.select(
        "code", F.when(old, F.col("b.day")).otherwise(F.col("date")).alias("date"), F.col("date").alias("at"), old.alias("old"), F.coalesce(some("open"), some("pre_close"), "before").alias("open"), F.coalesce(some("high"), "price").alias("high"),
        F.coalesce(some("low"), "price").alias("low"), F.col("price").alias("close"), some("volume").alias("volume"), "amount", "pct_chg", "b",
    )
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    bars = rows.groupBy("code", "date", "old").agg(*(F.max_by(c, "at").alias(c) for c in ("open", "high", "low", "close", "b")), *(newest(c).alias(c) for c in ("volume", "amount", "pct_chg")))
    stay = lambda c: F.coalesce(c, F.when(F.col("old"), F.col(f"b.{c}")).otherwise(0.0)).alias(c)
    return bars.select("code", "date", "open", "high", "low", "close", *(stay(c) for c in ("volume", "amount", "pct_chg")))


def store_bars(store: versions.Versions, bars: DataFrame) -> int:
    """Bars (code, date, BAR) as version 0 of two tables: all of them by month, and the newest of each code by a hash of the code."""
    bars = writes.kept(bars.select("code", "date", *BAR), "bars")
    last = bars.groupBy("code").agg(F.max_by(F.struct("date", *BAR), "date").alias("b")).select("code", "b.*")
    tables = {"bars": (bars, versions.month("date")), "last": (last, versions.bucket("code"))}
    return store.commit({t: versions.Change(df.select("code", "date", *BAR).withColumn(versions.PART, part), versions.touched(df, part)) for t, (df, part) in tables.items()})


def merge_quotes(store: versions.Versions, quotes: DataFrame, batch: int, stream: str = "quotes") -> int:
    """One batch of quotes into the tables of store_bars: the months and codes that it touches are rewritten, in one commit. Of a batch
    the last quote of a code and day counts, by `at`. A batch that is in already changes nothing."""
    base = store.version()
    if base.batches.get(stream, -1) >= batch:
        return base.number
    columns = [c for c in quotes.columns if c not in ("code", "date", "at")]
    q = quotes.groupBy("code", "date").agg(F.max_by(F.struct(*columns), "at").alias("q")).select("code", "date", "q.*")
    codes = versions.touched(q, versions.bucket("code"))
    last = store.read("last", base, codes)
    new = writes.kept(intraday(q, last), "bars")
    if new.isEmpty():
        return store.commit({}, base, stream, batch)
    months = versions.touched(new, versions.month("date"))
    bars = writes.upsert(store.read("bars", base, months), new, ["code", "date"])
    newest = new.groupBy("code").agg(F.max_by(F.struct("date", *BAR), "date").alias("b")).select("code", "b.*")
    newest = writes.upsert(last, newest, ["code"]).select("code", "date", *BAR)
    changes = {"bars": versions.Change(bars.withColumn(versions.PART, versions.month("date")), months), "last": versions.Change(newest.withColumn(versions.PART, versions.bucket("code")), codes)}
    return store.commit(changes, base, stream, batch)


def upsert_stream(quotes: DataFrame, store: versions.Versions, checkpoint: str, stream: str = "quotes") -> None:
    """Runs a stream of quotes into the tables of store_bars until all that is there is read. It may be stopped anywhere and started again
    on the same checkpoint: a batch either is in the log of versions, or it isn't there at all."""
    quotes.writeStream.foreachBatch(lambda batch, number: merge_quotes(store, batch, number, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(query_name: str, stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream until it has read what is there, and returns what it gave: files beside the checkpoint, so nothing is
    held by the driver. In complete mode each batch replaces the one before."""
    out = f"{checkpoint}-out"
    writer = stream.writeStream.queryName(query_name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
