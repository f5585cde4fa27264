"""Analysis history, candidates, tasks, bars in context, and write plans that the other modules do not have."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import ma_status
from marketloom.operators.numbering import numbered, ranged
from marketloom.sources.writes import kept


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page (from 1) with the number of all rows, in order. Ranges of the order are counted, and only those with rows of the page are
    read and sorted for it; the page's place in its ranges follows from the counts, however deep it lies."""
    rows, ranges = ranged(df, list(order), "pages")
    found = ranges.collect()  # a row for each range
    total, begin = sum(r["n"] for r in found), (number - 1) * size
    some = [r for r in found if r["before"] < begin + size and r["before"] + r["n"] > begin]
    place = F.lit(None).cast("long")
    for r in some:
        place = F.when(F.shiftright("_i", 33) == r["part"], F.lit(r["before"])).otherwise(place)
    place = place + F.col("_i").bitwiseAND((1 << 33) - 1)
    read = rows.where(F.col("_i") < 0) if not some else rows.where(F.col("_i").between(some[0]["part"] << 33, (some[-1]["part"] << 33) + some[-1]["n"]))
    return read.withColumn("_n", place).where((F.col("_n") >= begin) & (F.col("_n") < begin + size)).orderBy("_n").drop("_n", "_i").withColumn("total", F.lit(total).cast("long"))


def bar_context(bars: DataFrame) -> DataFrame:
    """bars: code, date, close, volume, ma5, ma10, ma20. Of each symbol's last bar: the close before, how volume and price
    changed against it, and the status of its averages if there is one."""
    w = Window.partitionBy("code").orderBy("date")
    df = bars.withColumns({"prev_close": F.lag("close").over(w), "prev_volume": F.lag("volume").over(w), "prev_date": F.lag("date").over(w), "_r": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))}).where("_r = 1")
    ratio = F.when(F.col("prev_volume") > 0, F.col("volume") / F.col("prev_volume"))
    change = F.when(F.col("prev_close") > 0, (F.col("close") - F.col("prev_close")) * 100 / F.col("prev_close"))
    status = F.when(F.col("prev_date").isNotNull(), ma_status(F.col("close"), F.col("ma5"), F.col("ma10"), F.col("ma20")))
    return df.select("code", "date", "close", "prev_date", "prev_close", ratio.alias("volume_change_ratio"), change.alias("price_change_pct"), status.alias("ma_status"))


def recent_signals(history: DataFrame, now: Column, excluded: DataFrame | None = None, days: int = 90, most: int = 5) -> DataFrame:
    """history: id, code, query_id, created_at and others. excluded: code, query_id. The latest of each code, without the
    query that is excluded for it; a record without a query id goes too where one is excluded."""
    rows = history.where(F.col("created_at") >= now - F.expr(f"interval {int(days)} days"))
    if excluded is not None:
        rows = rows.join(excluded.withColumnRenamed("query_id", "_not"), "code", "left").where(F.col("_not").isNull() | (F.col("query_id") != F.col("_not"))).drop("_not")
    r = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("rank", r).where(F.col("rank") <= most)


def candidates_with_ai(candidates: DataFrame, results: DataFrame, news: DataFrame, ai_top_k: int) -> DataFrame:
    """candidates: run_id, code, rank, ai_query_id. results: query_id, code, summary, advice. news: query_id, code. AI results
    and news belong to a candidate by query id and code; the same query of another code doesn't match."""
    r = results.select(F.col("query_id").alias("ai_query_id"), "code", F.col("summary").alias("ai_summary"), F.col("advice").alias("ai_advice"))
    n = news.groupBy(F.col("query_id").alias("ai_query_id"), "code").agg(F.count("*").alias("news_count"))
    df = candidates.join(r, ["ai_query_id", "code"], "left").join(n, ["ai_query_id", "code"], "left")
    return df.withColumns({"news_count": F.coalesce("news_count", F.lit(0)), "selected_for_ai": F.col("rank") <= ai_top_k})


def news_top_m(selected: int, ai_top_k: int) -> int:
    """How many candidates get news: at least five where there are so many, and all that go to the AI."""
    return 0 if selected <= 0 else min(selected, max(ai_top_k, min(5, selected)))


def checked_limits(candidate_limit: int, ai_top_k: int) -> tuple[int, int]:
    if ai_top_k > candidate_limit:
        raise ValueError("ai_top_k must not exceed candidate_limit")
    return candidate_limit, ai_top_k


def run_id(market: str, config: dict[str, Any]) -> str:
    """The same for the same market and settings, whatever their order."""
    text = json.dumps({"market": market, "config_snapshot": config}, sort_keys=True, ensure_ascii=True)
    return f"run-{hashlib.sha1(text.encode('utf-8')).hexdigest()[:32]}"


def learning_summary(summary: DataFrame) -> DataFrame:
    """Ratios of a backtest summary as the memory of strategies reads them: half where unknown, no return where unknown."""
    ratio = lambda c, other: F.coalesce(c / 100, F.lit(other))
    mean = F.coalesce("avg_simulated_return_pct", "avg_stock_return_pct")
    return summary.select("code", ratio(F.col("win_rate_pct"), 0.5).alias("win_rate"), ratio(F.col("direction_accuracy_pct"), 0.5).alias("direction_accuracy"), ratio(mean, 0.0).alias("avg_return"))


def touched_summaries(old: DataFrame, results: DataFrame, touched: DataFrame) -> DataFrame:
    """The table of summaries after results of some codes changed: theirs and the overall one are computed anew. Results of other codes are
    grouped under null, so that what holds for touched codes only (a filter with a cast) is never asked of '__overall__'."""
    from marketloom.operators.backtest import summary

    some = touched.select("code").distinct()
    marked = results.join(some.withColumn("_touched", F.lit(True)), "code", "left")
    new = summary(marked.withColumn("code", F.when(F.col("_touched"), F.col("code"))).drop("_touched")).where("code is not null")
    gone = some.unionByName(some.sparkSession.sql("SELECT '__overall__' AS code"))
    return old.join(gone, "code", "left_anti").unionByName(new)


def task_page(tasks: DataFrame, most: int) -> DataFrame:
    """tasks: id, status, created_at. The newest."""
    return tasks.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def trimmed_tasks(tasks: DataFrame, most: int) -> DataFrame:
    """Without the oldest finished tasks beyond `most` tasks in all; unfinished ones always stay. Each day's finished tasks are
    counted first, so that only those of the day that holds the cut are ordered."""
    done = F.col("status").isin("completed", "failed")
    total = tasks.count()
    if total <= most:
        return tasks
    days = tasks.where(done).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    until = days.withColumn("end", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each day
    rows = tasks.withColumn("day", F.to_date("created_at")).join(F.broadcast(until), "day", "left")
    order = F.row_number().over(Window.partitionBy("day", done).orderBy("created_at", "id"))
    gone = done & (F.col("end") - F.col("n") + order <= total - most)
    return rows.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone", "day", "n", "end")


def active_tasks(requests: DataFrame) -> DataFrame:
    """requests: id, code, created_at, finished_at (null: running). Adds accepted: whether no earlier accepted task of the code
    was still running. A request is a repeat of the one that runs, so after an accepted request the next is the first that starts when
    it has ended: a pointer, found for all at once by counting the starts before each end. From the first request of each code the
    pointers are followed by doubling them, so a code with many requests takes some rounds more and is dealt like any other."""
    far = F.lit("9999-12-31").cast("timestamp")
    rows = requests.select(F.col("id").alias("_id"), F.col("code").alias("_code"), "created_at", F.greatest(F.coalesce("finished_at", far), "created_at").alias("_end"))
    rows = kept(rows, "requests")
    starts = kept(numbered(rows, [F.col("_code"), F.col("created_at"), F.col("_id")], "i"), "starts")
    # an end stands before the starts of its moment; the starts before it are its place among all less its place among ends
    both = starts.select("_code", F.col("created_at").alias("at"), F.lit(1).alias("kind"), "i").unionByName(starts.select("_code", F.col("_end").alias("at"), F.lit(0).alias("kind"), "i"))
    order = [F.col("_code"), F.col("at"), F.col("kind"), F.col("i")]
    ends = kept(numbered(both, order, "p").where("kind = 0").select("_code", "at", "kind", "i", "p"), "ends")
    follows = numbered(ends, order, "q").select("_code", F.col("i").alias("of"), (F.col("p") - F.col("q")).alias("to"))
    spans = kept(starts.groupBy("_code").agg(F.min("i").alias("first"), F.max("i").alias("last")), "spans")
    # a task without length ends at the place of its own start; the next request follows it
    jump = follows.withColumn("to", F.greatest("to", F.col("of") + 1)).join(spans, follows["_code"].eqNullSafe(spans["_code"])).where(F.col("to") <= F.col("last")).select("of", "to")
    jump = kept(jump, "jumps")
    found = kept(spans.select(F.col("first").alias("i")), "found")
    while not jump.isEmpty():
        more = found.join(jump, found["i"] == jump["of"]).select(F.col("to").alias("i"))
        found = kept(found.unionByName(more).distinct(), "found")
        far_jump = jump.select(F.col("of"), F.col("to").alias("via")).join(jump.select(F.col("of").alias("via"), "to"), "via").select("of", "to")
        jump = kept(far_jump, "jumps")
    accepted = starts.join(found.withColumn("accepted", F.lit(True)), "i", "left").select("_id", "_code", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return requests.join(accepted, (requests["id"] == accepted["_id"]) & requests["code"].eqNullSafe(accepted["_code"])).drop("_id", "_code")


def without_codes(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select(F.upper(F.trim("code")).alias("code")).distinct(), "code", "left_anti")


def ordered_merge(*lists: Column) -> Column:
    """Distinct members of all lists in the order of their first place."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def sorted_codes(codes: Column) -> Column:
    upper = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(upper, lambda x: x.isNotNull() & (x != ""))))


def filled_entries(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda k, v: v.isNotNull())


def resumed(runs: DataFrame) -> DataFrame:
    """runs: run_id, status, resume_from, bars_ready. The stage at which a failed run starts again: the one asked for if it is
    ingesting or factorizing (factorizing needs bars), else the beginning."""
    at = F.when(F.col("status") != "failed", None).when((F.col("resume_from") == "factorizing") & F.col("bars_ready"), "factorizing").when(F.col("resume_from").isin("ingesting", "factorizing"), "ingesting").otherwise("pending")
    return runs.withColumn("resume_at", at)
