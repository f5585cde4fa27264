"""Connected components by alternating large and small stars.

The least neighbours of a round are written before they are joined to the edges, so both sides of the join are dealt anew:
few of them are broadcast by their size, and of many a hub's partition can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(written(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(written(least, "least"), "u")
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return tied.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node of its component) for every node of links. Each round is written, and the rounds end
    when the edges are stars around roots; their number grows with the logarithm of a component's diameter."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        last, edges = edges, written(_small_star(written(_large_star(edges), "edges")), "edges")
        discard(last)
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
