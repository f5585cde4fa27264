"""Past recommendations against the bars that followed: all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.advice import direction, position
from marketloom.operators.asof import asof


def W() -> WindowSpec:  # noqa: N802  windows need a session, so they are made when asked for
    return Window.partitionBy("code").orderBy("date")



def with_forward(bars: DataFrame, days: int) -> DataFrame:
    """Bars with `ahead`, the next `days` bars in order."""
    bar = F.struct("date", "high", "low", "close")
    return bars.select("code", "date", "close", F.collect_list(bar).over(W().rowsBetween(1, days)).alias("ahead"))


def candidates(analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Analyses without a result yet; results: id."""
    return analyses.join(results.select("id"), "id", "left_anti")


def evaluate(analyses: DataFrame, bars: DataFrame, days: int = 10, stop: float = 0.05, take: float = 0.10, band: float = 2.0) -> DataFrame:
    """analyses: id, code, date, advice. The window starts after the bar that is current on the analysis date; targets are
    shares of its close. Analyses before any bar are left out, as there is nothing to price them with."""
    df = asof(analyses, with_forward(bars, days), ["code"], "date", "date", "b").where("b is not null")
    df = df.select("id", "code", "advice", F.col("b.date").alias("start_date"), F.col("b.close").alias("start"), F.col("b.ahead").alias("ahead"))
    df = df.withColumns({"direction": direction(F.col("advice")), "position": position(F.col("advice")), "stop_price": F.col("start") * (1 - stop), "take_price": F.col("start") * (1 + take)})
    status = F.when(F.col("start").isNull() | (F.col("start") <= 0), "error").when(F.size("ahead") < days, "insufficient_data").otherwise("completed")
    df = df.withColumn("eval_status", status)
    done, long = F.col("eval_status") == "completed", F.col("position") == "long"
    df = df.withColumn("end", F.when(done, F.element_at("ahead", -1)["close"])).withColumn("stock_return_pct", (F.col("end") - F.col("start")) * 100 / F.col("start"))
    r, d = F.col("stock_return_pct"), F.col("direction")
    outcome = (
        F.when(r.isNull(), None)
        .when(d == "up", F.when(r >= band, "win").when(r <= -band, "loss").otherwise("neutral"))
        .when(d == "down", F.when(r <= -band, "win").when(r >= band, "loss").otherwise("neutral"))
        .when(d == "not_down", F.when(r >= 0, "win").when(r <= -band, "loss").otherwise("neutral"))
        .otherwise(F.when(F.abs(r) <= band, "win").otherwise("loss"))
    )
    day = lambda x, i: F.struct((i + 1).alias("k"), F.coalesce(x["low"] <= F.col("stop_price"), F.lit(False)).alias("s"), F.coalesce(x["high"] >= F.col("take_price"), F.lit(False)).alias("t"))
    df = df.withColumn("outcome", outcome).withColumn("hit", F.when(done & long, F.try_element_at(F.filter(F.transform("ahead", day), lambda x: x["s"] | x["t"]), F.lit(1))))
    s, t = F.coalesce(F.col("hit.s"), F.lit(False)), F.coalesce(F.col("hit.t"), F.lit(False))
    first: Column = F.when(~done, None).when(~long, "not_applicable").when(s & t, "ambiguous").when(s, "stop_loss").when(t, "take_profit").otherwise("neither")
    exit_ = F.when(s, F.col("stop_price")).when(t, F.col("take_price")).otherwise(F.col("end"))
    return df.select(
        "id", "code", "advice", "start_date", "start", "end", "eval_status", "direction", "position", "stock_return_pct", "outcome",
        F.when(F.col("outcome") == "win", True).when(F.col("outcome") == "loss", False).alias("direction_correct"),
        F.when(done & long, s).alias("hit_stop_loss"), F.when(done & long, t).alias("hit_take_profit"), first.alias("first_hit"), F.col("hit.k").alias("first_hit_days"),
        F.when(done, F.when(long, (exit_ - F.col("start")) * 100 / F.col("start")).otherwise(0.0)).alias("simulated_return_pct"),
        F.when(done, F.array_max(F.transform("ahead", lambda x: x["high"]))).alias("max_high"), F.when(done, F.array_min(F.transform("ahead", lambda x: x["low"]))).alias("min_low"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Metrics for every symbol and overall (code __overall__) in one pass; percentages are null on empty denominators."""
    done = F.col("eval_status") == "completed"
    long = done & (F.col("position") == "long")
    n = lambda c: F.count_if(c)
    pct = lambda a, b: F.try_divide(a, b) * 100
    win, loss = n(done & (F.col("outcome") == "win")), n(done & (F.col("outcome") == "loss"))
    hit = F.col("first_hit_days").isNotNull()
    stops, takes = long & F.col("hit_stop_loss").isNotNull(), long & F.col("hit_take_profit").isNotNull()
    targets = stops | takes
    g = results.rollup("code").agg(
        F.grouping_id().alias("_all"), F.count("*").alias("total"), n(done).alias("completed"), n(F.col("eval_status") == "insufficient_data").alias("insufficient"),
        n(long).alias("long"), n(done & (F.col("position") == "cash")).alias("cash"), win.alias("win"), loss.alias("loss"), n(done & (F.col("outcome") == "neutral")).alias("neutral"),
        pct(n(done & F.col("direction_correct")), n(done & F.col("direction_correct").isNotNull())).alias("direction_accuracy_pct"), pct(win, win + loss).alias("win_rate_pct"), pct(n(done & (F.col("outcome") == "neutral")), n(done)).alias("neutral_rate_pct"),
        F.avg(F.when(done, F.col("stock_return_pct"))).alias("avg_stock_return_pct"), F.avg(F.when(done, F.col("simulated_return_pct"))).alias("avg_simulated_return_pct"),
        pct(n(stops & F.col("hit_stop_loss")), n(stops)).alias("stop_loss_rate"), pct(n(takes & F.col("hit_take_profit")), n(takes)).alias("take_profit_rate"),
        pct(n(targets & (F.col("first_hit") == "ambiguous")), n(targets)).alias("ambiguous_rate"), F.avg(F.when(targets & hit & F.col("first_hit").isin("stop_loss", "take_profit", "ambiguous"), F.col("first_hit_days"))).alias("avg_days_to_first_hit"),
    )
    return g.withColumn("code", F.when(F.col("_all") == 1, "__overall__").otherwise(F.col("code"))).drop("_all")


def advice_breakdown(results: DataFrame) -> DataFrame:
    advice = F.when(F.trim(F.coalesce("advice", F.lit(""))) == "", "(unknown)").otherwise(F.trim("advice"))
    win, loss = F.count_if(F.col("outcome") == "win"), F.count_if(F.col("outcome") == "loss")
    return results.where("eval_status = 'completed'").groupBy(advice.alias("advice")).agg(F.count("*").alias("total"), win.alias("win"), loss.alias("loss"), (F.try_divide(win, win + loss) * 100).alias("win_rate_pct"))


def diagnostics(results: DataFrame) -> DataFrame:
    """kind, value, n: how many results have each status and each first hit."""
    kinds = F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.coalesce("eval_status", F.lit("(unknown)")).alias("value")), F.struct(F.lit("first_hit").alias("kind"), F.coalesce("first_hit", F.lit("(none)")).alias("value"))))
    return results.select(kinds.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def strategy_weights(stats: DataFrame, least: int = 30) -> DataFrame:
    """stats: strategy, samples, win_rate. Weights average 1; a strategy with few samples weighs as one of average luck."""
    raw = F.when(F.col("samples") >= least, 0.5 + F.col("win_rate")).otherwise(1.0)
    df = stats.withColumn("raw", raw)
    return df.withColumn("weight", F.coalesce(F.try_divide("raw", F.avg("raw").over(Window.partitionBy(F.lit(1)))), F.lit(1.0)))  # a row for each strategy


def calibration(stats: DataFrame, confidence: float = 0.6) -> DataFrame:
    """stats: strategy, accuracy. factor: accuracy over the usual confidence, within [0.5, 1.5]."""
    return stats.withColumn("factor", F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("accuracy") / confidence)))


def consensus(opinions: DataFrame, weights: DataFrame) -> DataFrame:
    """opinions: code, strategy, score (1 to 5), confidence. weights: strategy, weight (absent: 1)."""
    w = F.coalesce("weight", F.lit(1.0))
    g = opinions.join(weights.select("strategy", "weight"), "strategy", "left").groupBy("code").agg(F.sum(w).alias("w"), F.sum(F.col("score") * w).alias("s"), F.sum(F.col("confidence") * w).alias("c"), F.count("*").alias("n"))
    by = F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))
    g = g.withColumn("score", F.col("s") / by).withColumn("confidence", F.col("c") / by)
    signal = F.when(F.col("score") >= 4.5, "strong_buy").when(F.col("score") >= 3.5, "buy").when(F.col("score") >= 2.5, "hold").when(F.col("score") >= 1.5, "sell").otherwise("strong_sell")
    return g.select("code", "n", "score", "confidence", signal.alias("signal"))
