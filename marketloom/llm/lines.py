"""Line dedup: later copies of repeated line runs are deleted. DataFrame functions only.

Every worded line is a letter; every distinct text is a string of such letters. A suffix array over these strings is built
by prefix doubling: a position's rank is the number of positions whose suffix is smaller in its first h lines, and a round
doubles h by ranking the pairs (rank here, rank h lines on). Positions of equal rank are an interval of the array whose
longest common prefix is at least h lines. Rounds go on until no interval holds two positions; what is alone in its interval,
or has no more h lines before its stretch ends, is settled and leaves the rounds.

Ranks are made from the table of distinct pairs with their counts, so a line that a third of all texts hold is one row there.
Pairs are put in order within buckets of the second rank, about as many as the root of the number of positions, and buckets
within the first, so neither step gathers the successors of one line in a task.

A run counts if it has min_words words. In an interval the position that comes first, by (doc_id, line), stays; every other
one begins a later copy of h lines. Intervals of more than min_words lines are taken from the rounds as they are. The shorter
runs are the shortest with min_words words that begin or end at a line, and the interval of such a run of m lines is known
from two overlapping ranks of depth 2 ** floor(log2 m). The union of all later copies is what the maximal repeated runs cover:
one of L lines is covered by the two of 2 ** floor(log2 L) at its ends.

Lines compare without white space at their ends. Lines without words are no letters: runs reach over them and they stay.
Whole copies collapse before the array: a text is represented by its least doc_id, its other copies lose all worded lines
if it has min_words words, and are left with empty text. Rows with the same id and text are one document and are treated
alike. Null ids come last; null text stays null. Other columns, of any name, stay as they are. An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import WORD, digest, written

MIN_WORDS = 6
BLANK_ENDS = " \t\r\x0b\x0c"


def _letters(text: Column) -> Column:
    """The worded lines of a text: name, words and place of each."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.unhex(F.md5(F.btrim(x, F.lit(BLANK_ENDS)).cast("binary"))).alias("name"), F.regexp_count(x, F.lit(WORD)).alias("n"), i.alias("line")))
    return F.filter(lines, lambda x: x["n"] > 0)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_digest, first_id, copies, letters of each distinct text."""
    text = docs[text_col].cast("string")
    slim = docs.where(text.isNotNull()).select(docs[id_col].alias("id"), digest(text).alias("_digest"), _letters(text).alias("letters"))
    return slim.groupBy("_digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("letters").alias("letters"))


def positions(texts: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """(_digest, seg, ord, line, n, p, r0) of the lines that occur again, where they stand in stretches of min_words words, and
    how many there are. A run that repeats lies within such a stretch. p numbers them by (doc_id, line)."""
    rows = texts.select("_digest", "first_id", F.posexplode("letters").alias("ord", "x")).select("_digest", "first_id", "ord", "x.name", "x.n", "x.line")
    repeated = rows.groupBy("name").agg(F.count("*").alias("count")).where("count > 1")
    # counted names are written, so that both sides of the join are dealt anew and a hot name's partition can be split
    again = rows.join(written(repeated.select("name"), "names"), "name", "left_semi")
    here = Window.partitionBy("_digest").orderBy("ord")
    again = again.withColumn("seg", F.col("ord") - F.row_number().over(here))
    again = again.withColumn("words", F.sum("n").over(Window.partitionBy("_digest", "seg"))).where(F.col("words") >= min_words).drop("words")
    order = [F.asc_nulls_last("first_id"), "_digest", "ord"]
    again = written(again.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.monotonically_increasing_id()).drop("first_id"), "again")
    total = again.count()
    # depth 1: places by order of names, in buckets of their first letters, about as many as the root of the positions
    letters = max(1, math.ceil(math.log(max(2, total), 16) / 2))
    names = again.groupBy("name").agg(F.count("*").alias("count")).withColumn("bucket", F.substring(F.hex("name"), 1, letters))
    buckets = names.groupBy("bucket").agg(F.sum("count").alias("count"))
    before = buckets.select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    ranked = names.join(before, "bucket").select("name", (F.col("base") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("r0"))
    return again.join(written(ranked, "ranks"), "name").drop("name"), total


def ranked_pairs(pairs: DataFrame, rank: str, to: str, total: int) -> DataFrame:
    """pairs: rank, _next, _count, each pair once. Adds `to`, the rank of the pair."""
    pairs = pairs.withColumn("_bucket", F.floor(F.col("_next") / F.lit(math.isqrt(total) + 1)))
    buckets = pairs.groupBy(rank, "_bucket").agg(F.sum("_count").alias("_of_bucket"))
    below = Window.partitionBy(rank).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(rank, "_bucket", F.coalesce(F.sum("_of_bucket").over(below), F.lit(0)).alias("_base"))
    smaller = Window.partitionBy(rank, "_bucket").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
    out = pairs.join(buckets, [rank, "_bucket"]).withColumn(to, F.col(rank) + F.col("_base") + F.coalesce(F.sum("_count").over(smaller), F.lit(0)))
    return out.drop("_bucket", "_base")


def doubled(p: DataFrame, rank: str, to: str, h: int, total: int) -> DataFrame:
    """Adds the ranks at depth 2h from those at depth h, for all positions."""
    on = Window.partitionBy("_digest", "seg").orderBy("ord")
    p = written(p.withColumn("_next", F.coalesce(F.lead(rank, h).over(on), F.lit(-1).cast("long"))), "positions")
    pairs = p.groupBy(rank, "_next").agg(F.count("*").alias("_count"))
    named = ranked_pairs(pairs, rank, to, total).select(rank, "_next", to)
    return p.join(written(named, "ranks"), [rank, "_next"]).drop("_next")  # written: see positions()


def long_copies(p: DataFrame, rank: str, h: int, total: int) -> list[DataFrame]:
    """p: positions with their ranks at depth h. For each depth 2h, 4h, ... at which an interval holds two positions: _digest,
    start, m of the positions that aren't first in theirs."""
    rows, out = p.select("_digest", "seg", "ord", "p", F.col(rank).alias("r")), []
    while True:
        on = Window.partitionBy("_digest", "seg").orderBy("ord").rangeBetween(h, h)
        ahead = written(rows.select("_digest", "seg", "ord", "p", "r", F.max("r").over(on).alias("_next")).where("_next is not null"), "positions")
        pairs = ahead.groupBy("r", "_next").agg(F.count("*").alias("_count"), F.min("p").alias("first"))
        named = written(ranked_pairs(pairs, "r", "rank", total).where("_count > 1").select("r", "_next", "rank", "first"), "ranks")
        if named.isEmpty():
            return out
        h *= 2
        rows = written(ahead.join(named, ["r", "_next"]).select("_digest", "seg", "ord", "p", F.col("rank").alias("r"), "first"), "suffixes")
        out.append(rows.where("p > first").select("_digest", F.col("ord").alias("start"), F.lit(h).alias("m")))


def later_copies(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_digest, line: the lines to delete from the representative of each text."""
    p, total = positions(texts, min_words)
    depth = max(0, min_words.bit_length() - 1)  # 2 ** depth lines at most in the shortest runs' halves
    for k in range(depth):
        p = doubled(p, f"r{k}", f"r{k + 1}", 1 << k, total)
    p = written(p, "suffixes")
    long = long_copies(p, f"r{depth}", 1 << depth, total)
    ranks = [f"r{k}" for k in range(depth + 1)]
    if long:  # a shortest run at the start of a longer later copy is covered by it, and isn't first in its interval either
        marked = p.join(long[0].select("_digest", F.col("start").alias("ord"), F.lit(True).alias("within")), ["_digest", "ord"], "left")
    else:
        marked = p.withColumn("within", F.lit(None).cast("boolean"))
    row = F.struct("n", "p", "within", *ranks)
    on = Window.partitionBy("_digest", "seg").orderBy("ord")
    around = marked.select("_digest", "ord", F.collect_list(row).over(on.rowsBetween(0, min_words - 1)).alias("ahead"), F.collect_list(row).over(on.rowsBetween(1 - min_words, 0)).alias("behind"))

    def lines_needed(rows: Column) -> Column:
        """How many of the rows, from the first, have min_words words; null if all have fewer."""
        zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
        return F.aggregate(rows, zero, lambda a, x: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["words"] + x["n"]).alias("words"), (a["lines"] + 1).alias("lines"))), lambda a: F.when(a["words"] >= min_words, a["lines"]))

    ahead = around.withColumn("m", lines_needed(F.col("ahead"))).where("m is not null").select("_digest", F.col("ord").alias("start"), "m", F.slice("ahead", 1, F.col("m")).alias("run"))
    behind = around.withColumn("m", lines_needed(F.reverse("behind"))).where("m is not null").select("_digest", (F.col("ord") - F.col("m") + 1).alias("start"), "m", F.slice("behind", -F.col("m"), F.col("m")).alias("run"))
    runs = ahead.unionByName(behind).where(F.element_at("run", 1)["within"].isNull())
    left = right = F.lit(None).cast("long")
    for k in range(depth + 1):  # depth of m: 2 ** k <= m < 2 ** (k + 1)
        at = F.col("m").between(1 << k, (2 << k) - 1)
        left = F.when(at, F.element_at("run", 1)[f"r{k}"]).otherwise(left)
        right = F.when(at, F.element_at("run", (F.col("m") - (1 << k) + 1).cast("int"))[f"r{k}"]).otherwise(right)
    runs = written(runs.select("_digest", "start", "m", left.alias("left"), right.alias("right"), F.element_at("run", 1)["p"].alias("p")), "runs")
    first = runs.groupBy("m", "left", "right").agg(F.min("p").alias("first"), F.max("p").alias("last")).where("first <> last").drop("last")
    copies = runs.join(written(first, "first"), ["m", "left", "right"]).where("p > first").select("_digest", "start", "m")
    for x in long:
        copies = copies.unionByName(x)
    # each position knows how far the copies that begin at it reach; a line goes if one from it or before reaches over it
    reach = copies.groupBy("_digest", F.col("start").alias("ord")).agg(F.max("m").alias("m"))
    until = F.max(F.col("ord") + F.col("m")).over(Window.partitionBy("_digest").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return p.select("_digest", "ord", "line").join(reach, ["_digest", "ord"], "left").withColumn("until", until).where(F.col("until") > F.col("ord")).select("_digest", "line")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_digest, _first_id, _whole (copies lose all), _kept: the stretches of lines [a, b) that stay in the representative,
    for each text that loses something."""
    texts = written(texts_of(docs, id_col, text_col), "texts")
    dead = later_copies(texts, min_words)
    rows = Window.partitionBy("_digest").orderBy("line")
    islands = dead.withColumn("grp", F.col("line") - F.row_number().over(rows)).groupBy("_digest", "grp").agg(F.min("line").alias("a"), (F.max("line") + 1).alias("b"))
    lists = islands.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("dead"))
    words = F.aggregate("letters", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    heads = texts.select("_digest", F.col("first_id").alias("_first_id"), ((F.col("copies") > 1) & (words >= min_words)).alias("_whole"))
    end = F.lit(2**31 - 1)
    edges = F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), F.coalesce("dead", F.array().cast("array<struct<a:int,b:int>>")), F.array(F.struct(end.alias("a"), end.alias("b"))))
    found = heads.join(lists, "_digest", "left").where("_whole or dead is not null").withColumn("_edges", edges)
    kept = F.expr("transform(sequence(1, size(_edges) - 1), i -> struct(_edges[i - 1].b as a, _edges[i].a as b))")
    return found.select("_digest", "_first_id", "_whole", kept.alias("_kept"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col shortened; same rows, same columns."""
    gone = written(deletions(docs, min_words, id_col, text_col), "deletions")
    # rows travel as one struct, so no column of theirs can clash with a work column
    marked = docs.select(F.struct(*docs.columns).alias("row"), digest(docs[text_col].cast("string")).alias("_digest"))
    rows = marked.join(gone, "_digest", "left")
    old = f"row.`{text_col}`"
    # the outer transform names the split lines, so that they are split once
    shorter = F.expr(f"transform(array(split({old}, '\\n', -1)), lines -> array_join(flatten(transform(_kept, k -> slice(lines, k.a + 1, greatest(0, least(k.b, size(lines)) - k.a)))), '\\n'))[0]")
    first = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_first_id"))
    blank_only = F.expr(f"array_join(filter(split({old}, '\\n', -1), x -> regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+') = 0), '\\n')")
    text = F.when(F.col("_kept").isNull(), F.col(old)).when(first, shorter).when(F.col("_whole"), blank_only).otherwise(shorter)
    text = F.when(F.col("_kept").isNotNull() & ~text.rlike(r"[^\x20\x09-\x0D]"), F.lit("")).otherwise(text)
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


#: The same for DuckDB, on `documents`, by the text of each shortest run.
ORACLE = f"""
WITH split_up AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS name,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM split_up WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), around AS (
  SELECT doc_id, i,
         list(struct_pack(name := name, n := n, i := i)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS ahead,
         list_reverse(list(struct_pack(name := name, n := n, i := i)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)) AS behind
  FROM worded
), needed AS (
  SELECT doc_id, ahead AS rows_, list_filter(range(1, len(ahead) + 1), lambda k: list_sum([x.n for x in ahead[1:k]]) >= {MIN_WORDS})[1] AS m, false AS back FROM around
  UNION ALL
  SELECT doc_id, behind, list_filter(range(1, len(behind) + 1), lambda k: list_sum([x.n for x in behind[1:k]]) >= {MIN_WORDS})[1], true FROM around
), runs AS (
  SELECT doc_id, CASE WHEN back THEN list_reverse(rows_[1:m]) ELSE rows_[1:m] END AS run FROM needed WHERE m IS NOT NULL
), placed AS (
  SELECT doc_id, run, rank() OVER (PARTITION BY [x.name for x in run] ORDER BY doc_id, run[1].i) AS k FROM runs
), dead AS (
  SELECT DISTINCT doc_id, unnest([x.i for x in run]) AS i FROM placed WHERE k > 1
), rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM split_up s
  WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.doc_id = s.doc_id AND d.i = s.i) GROUP BY doc_id
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL WHEN o.doc_id NOT IN (SELECT doc_id FROM dead) THEN o.text
                      WHEN regexp_matches(coalesce(r.text, ''), '[^\\x20\\x09-\\x0D]') THEN r.text ELSE '' END AS text
FROM documents o LEFT JOIN rest r ON o.doc_id = r.doc_id
"""
