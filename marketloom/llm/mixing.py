"""Mixing sources to target weights by capped water-filling.

Sources share `total` words by weight. A source is clamped at `cap` times its size, and what that frees is shared again
by weight until no target is above its cap. The result has a closed form: with sources in order of cap / weight there is a
level such that each target is min(cap, level * weight); one pass of running sums over the table of sources finds it.

A source's target is then drawn from its documents, whole repetitions first: with r = target / size each document is
taken floor(r) times, and the rest comes from documents in the order of a seeded hash, whole ones while they fit and a
last one in part. The order is cut by buckets of the hash: buckets below the cut are taken whole, buckets above it not at
all, and only the rows of the bucket that holds the cut are ordered, so no source is ever sorted in one task.
Documents are read three times (sizes, what is clear of the cut, the cut's bucket), and only those of the cut's bucket are
moved (all of them where there are more than MOST_BROADCAST sources; the result is the same). What is ordered are rows without
their other columns: rows of equal id and text are alike there, and find their share by it. Rows that repeat in id and text
share a bucket: those alone aren't spread.

Size is the number of words; null text has 0. A null source is a source of its own, last in order. Rows that repeat
count each. A source without words has target 0. Other columns are left out. Texts of any
length count whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import WORD, word_count, written

#: Letters of a bucket's name, and so 16 ** BUCKET buckets of each source.
BUCKET = 3
#: Sources up to which their table, a few numbers a row, is broadcast.
MOST_BROADCAST = 50_000
SEED = "mix-1"


def seeded_order(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """Hexadecimal letters that order documents at random, the same in every run: of id and text, so that neither an id nor a
    text that fills a third of all rows falls into one bucket."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources: source, source_size, a row each. Adds weight and target.

    The windows here see a row for each source, never a row for each document."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (k + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy(F.lit(1))
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.asc_nulls_last("source"))
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(float(epochs)),
            "bound_before": F.coalesce(F.sum("bound").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # the level if just the sources before this one were clamped; the first that then stays within its bound decides
    level = (F.col("total") - F.col("bound_before")) / F.col("weight_left")
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("bound"), level))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("bound", F.col("level") * F.col("weight"))
    return rows.withColumn("target", F.coalesce(target, F.col("bound"))).select("source", "source_size", "weight", "target")


def _keyed(docs: DataFrame, carry: list[str], seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The columns to carry travel as one struct, so none of them can clash with a work column."""
    u = seeded_order(docs[id_col], docs[text_col].cast("string"), seed)
    return docs.select(F.struct(*(docs[c] for c in carry)).alias("row"), docs[id_col].alias("_id"), docs[source_col].alias("_source"), word_count(docs[text_col].cast("string")).alias("_size"), u.alias("_u"), F.substring(u, 1, BUCKET).alias("_bucket"))


def _taken(docs: DataFrame, carry: list[str], weights: Sequence[float], epochs: float, cap: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _size, _source_size, _target, _whole, _extra (words beyond whole repetitions) and other work columns."""
    keyed = _keyed(docs, carry, seed, id_col, text_col, source_col)
    buckets = written(keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("bucket_size")), "buckets")  # a row for each source and bucket at most
    goals = targets(buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("bucket_size").alias("source_size")), weights, epochs, cap)
    goals = goals.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    goals = goals.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    # for each source the bucket that holds the cut, and the words it may still take there
    running = Window.partitionBy("b._source").orderBy("b._bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = buckets.alias("b").join(goals.alias("g"), F.col("b._source").eqNullSafe(F.col("g.source"))).select("g.*", "b._bucket", "b.bucket_size", F.sum("b.bucket_size").over(running).alias("end"))
    over = F.col("end") > F.col("rest")
    cut = ends.groupBy(F.col("source").alias("_s")).agg(
        F.first("source_size").alias("_source_size"), F.first("target").alias("_target"), F.first("whole").alias("_whole"), F.min(F.when(over, F.col("_bucket"))).alias("_cut"),
        F.min_by(F.col("rest") - F.col("end") + F.col("bucket_size"), F.when(over, F.col("_bucket"))).alias("_room"),
    )
    cut = written(cut, "cut")
    # a row for each source: small enough to send to every task unless there are very many, and then rows are dealt by source
    few = cut.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = keyed.join(F.broadcast(cut) if few else cut.hint("merge"), keyed["_source"].eqNullSafe(cut["_s"]))
    before, at = F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")), F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    clear = rows.where(~at).withColumn("_extra", F.when(before, F.col("_size")).otherwise(F.lit(0)).cast("long"))
    # only the bucket with the cut is put in order, by what orders it; rows alike in that take turns
    place = F.concat("_u", F.when(F.col("_source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("_source").cast("string"))))
    at_cut = written(rows.where(at).withColumn("_place", place), "cut-rows")
    order = Window.partitionBy("_source").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    places = at_cut.groupBy("_place", "_source", "_u").agg(F.sum("_size").alias("_sizes"))
    places = places.select("_place", F.coalesce(F.sum("_sizes").over(order), F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("_place").orderBy("_u")) - 1
    at_cut = at_cut.join(places, "_place").withColumn("_before", F.col("_before") + turn * F.col("_size"))
    at_cut = at_cut.withColumn("_extra", F.greatest(F.lit(0), F.least("_size", F.col("_room") - F.col("_before")))).drop("_place", "_before")
    return clear.unionByName(at_cut)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of docs."""
    rows = _taken(docs, [id_col, source_col], weights, epochs, cap, seed, id_col, text_col, source_col)
    taken = (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long")
    return rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{source_col}`").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for each repetition, with the columns of docs. A repetition in part, of which each source has
    one at most, holds the first words joined by one space. Rows of which no word is taken are left out."""
    rows = _taken(docs, docs.columns, weights, epochs, cap, seed, id_col, text_col, source_col)
    times = F.col("_whole") + (F.col("_extra") > 0).cast("long")
    rows = rows.where((F.col("_size") > 0) & (times > 0)).withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("_turn") > F.col("_whole")) & (F.col("_extra") < F.col("_size"))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.`{text_col}`").cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_extra").cast("int")), " ")
    text = F.when(part, words).otherwise(F.col(f"row.`{text_col}`"))
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS u
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS bound
  FROM sources
), filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total,
         coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS bound_before,
         sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed
), levels AS (
  SELECT *, min_by((total - bound_before) / weight_left, bound / weight) FILTER (WHERE (total - bound_before) / weight_left * weight <= bound) OVER () AS level
  FROM filled
), goals AS (
  SELECT source, source_size, coalesce(least(bound, level * weight), bound) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM goals
)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       CAST(p.whole * d.size + greatest(0, least(d.size, CAST(floor(p.target - p.whole * p.source_size) AS BIGINT)
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
"""
