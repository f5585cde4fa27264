"""News that several providers return: which provider counts, which items stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failover_after_filter(items: DataFrame, today: Column, days: int, most: int) -> DataFrame:
    """items: request, provider (its place), ord, published and others. Of each request the items of the first provider that
    has any left once old, future and undated ones are gone, in its order, `most` of them."""
    fresh = items.where(F.col("published").between(F.date_sub(today, days - 1), F.date_add(today, 1)))
    w = Window.partitionBy("request")
    best = fresh.withColumn("_p", F.min("provider").over(w)).where(F.col("provider") == F.col("_p")).drop("_p")
    return best.withColumn("rank", F.row_number().over(w.orderBy("ord"))).where(F.col("rank") <= most)


def round_robin(requests: DataFrame, providers: int) -> DataFrame:
    """requests: request, dimension (its place). The provider of each: dimensions take turns."""
    turn = F.row_number().over(Window.partitionBy("request").orderBy("dimension")) - 1
    return requests.withColumn("provider", turn % providers)


def enhanced(items: DataFrame, attempts: int, most: int, each: int = 3) -> DataFrame:
    """items: request, template, provider, ord, url. Of the first `attempts` templates, `each` items of the first provider that
    has some; a url counts where it comes first by template and order; `most` of them in that order."""
    w = Window.partitionBy("request", "template")
    some = items.where(F.col("template") < attempts).withColumn("_p", F.min("provider").over(w)).where(F.col("provider") == F.col("_p")).drop("_p")
    some = some.withColumn("_r", F.row_number().over(w.orderBy("ord"))).where(F.col("_r") <= each).drop("_r")
    once = some.withColumn("_r", F.row_number().over(Window.partitionBy("request", "url").orderBy("template", "ord"))).where("_r = 1").drop("_r")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("template", "ord"))).where(F.col("rank") <= most)


def recent(news: DataFrame, now: Column, days: int, most: int) -> DataFrame:
    """news: id, code, published, fetched. The latest of each code that were fetched within `days`: newest first by the day of
    publication, or of fetching where that is unknown."""
    rows = news.where(F.col("fetched") >= now - F.expr(f"interval {int(days)} days"))
    order = Window.partitionBy("code").orderBy(F.desc(F.coalesce("published", "fetched")), F.desc("fetched"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def published_around(pairs: DataFrame, window_days: int) -> DataFrame:
    """pairs: anchor (date), published (date) and others. Those published in [anchor - (window - 1), anchor + 1]; undated ones
    go."""
    return pairs.where(F.col("published").between(F.date_sub("anchor", max(0, window_days - 1)), F.date_add("anchor", 1)))
