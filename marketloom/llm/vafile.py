"""Exact top-k inner products over a vector-approximation file.

Components become integers floor(scale * x). The file is a table of blocks: for each block of vectors the number of the cell
that each component falls in (one byte), the grid of the cells, a hash of each vector, and the exact integers as a column of
their own, which the scan doesn't read.

1. A query scans cells: a vector's cells bound its inner product from above and below (distances the other way round). A
   sample of blocks gives each query a first threshold, the kth best lower bound there; the scan of all blocks then returns
   what is bounded above the threshold, and the kth best lower bound of that is the threshold of the next step.
2. Exact vectors are read in the order of their upper bounds, in rounds of growing number: a round names the places it needs in each
   block, and only those are unpacked and sent on. After a round the kth best exact score is known, and what is bounded below it is
   certain not to belong; when nothing else is left, the result is certain. The queries' own vectors stand in a column of the file, so
   finding them unpacks nothing else.

Blocks are packed where they are read, so a vector that repeats a great deal spreads over blocks like any other; of equal
vectors that a task holds, only the k + 1 with the smallest ids can be results, and only they are returned. Queries are packed
in groups. Each group of blocks meets each group of queries in one bounded task. Groups are tied by their numbers: no cross
join, no broadcast.

Vectors that are null or hold a null or non-finite component take no part; only vectors of a query's length are its
candidates. A query's own row is left out, other rows of the same id are not. Rows that repeat count each; ties go to the
smaller id, a null id last. Empty vectors take no part, vectors of any length do; an empty table gives no rows. Components beyond 62 bits and scores beyond 64 bits are held at the limit. Other columns are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.shipping import ship
from marketloom.llm.common import on_batches, written
from marketloom.llm.shingles import mix

BLOCK, BLOCKS_A_TASK, QUERIES_A_TASK = 512, 64, 1024
CELLS = 256
#: Exact vectors that a query reads in the first round, as a multiple of k, and how that grows.
AHEAD, GROWTH = 2, 4
_BLOCKS = "block long, dim int, ids array<long>, cells binary, grid binary, hashes binary, exact binary, asked array<int>"


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cells, grid of vectors (rows) of integers. The grid: the least component of each dimension, and a cell's width."""
    low = numbers.min(0).astype(np.float64)
    width = np.maximum((numbers.max(0).astype(np.float64) - low) / CELLS, 1e-9)
    return np.clip((numbers - low) / width, 0, CELLS - 1).astype(np.uint8), np.stack([low, width])


def vector_hashes(numbers: np.ndarray) -> np.ndarray:
    h = np.full(len(numbers), numbers.shape[1], np.uint64)
    for column in numbers.view(np.uint64).T:
        with np.errstate(over="ignore"):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def bounds(cells: np.ndarray, grid: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) of the inner products of queries (rows) with the vectors of a block (columns), wider by more than
    rounding can be off."""
    low, width = grid
    q = queries.astype(np.float64)
    near = (q * width) @ cells.T.astype(np.float64) + (q @ low)[:, None]
    room = (1e-9 * (np.abs(q) @ (np.abs(low) + CELLS * width)) + 1)[:, None]
    return near + (np.maximum(q, 0) @ width)[:, None] + room, near + (np.minimum(q, 0) @ width)[:, None] - room


def build(vectors: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None) -> DataFrame:
    """The file: blocks of up to BLOCK vectors of one length, packed without a shuffle. is_query: of `id`; the places of such rows are kept
    for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = held.pop(dim)
            numbers = np.stack([v for _, v, _ in rows])
            cells, grid = pack(numbers)
            number += 1
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())), "cells": [cells.tobytes()], "grid": [grid.tobytes()], "hashes": [vector_hashes(numbers).tobytes()], "exact": [numbers.astype("<i8").tobytes()], "asked": pa.array([[n for n, (_, _, q) in enumerate(rows) if q]], pa.list_(pa.int32()))}
            )

        for batch in batches:
            for i, x, asked in zip(batch.column("id").to_pylist(), batch.column("v"), batch.column("q").to_pylist()):
                v = np.floor(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                rows = held.setdefault(len(v), [])
                rows.append((i, np.clip(v, -(2.0**62), 2.0**62).astype(np.int64), asked))
                if len(rows) == BLOCK:
                    yield block(len(v))
        for dim in sorted(held):
            yield block(dim)

    v = vectors[vector_col].cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound & (F.size(v) > 0)).select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("q", F.coalesce(is_query, F.lit(False)) if is_query is not None else F.lit(False))
    return written(on_batches(rows, run, _BLOCKS), "vafile")


def exact_vectors(places: DataFrame) -> DataFrame:
    """name, id, dim, v (64-bit integers) of the vectors at `places` (an array) of blocks. A name is made of the block and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, at = 8 * r["dim"], sorted(set(r["places"]))
                yield pa.RecordBatch.from_pydict({"name": pa.array([(r["block"] << 10) + n for n in at], pa.int64()), "id": pa.array([r["ids"][n] for n in at], pa.int64()), "dim": pa.array([r["dim"]] * len(at), pa.int32()), "v": pa.array([r["exact"][n * size : (n + 1) * size] for n in at], pa.binary())})

    return on_batches(places.select("block", "dim", "ids", "exact", "places"), run, "name long, id long, dim int, v binary")


def exact_of(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """The exact vectors of names: the places of each block, no more than a block holds, meet it, and nothing else is unpacked."""
    places = names.select("name").distinct().groupBy(F.shiftright("name", 10).alias("block")).agg(F.collect_list((F.col("name") % 1024).cast("int")).alias("places"))
    return exact_vectors(blocks.join(places, "block"))


def inner(numbers: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of rows as 64-bit integers, held at the limits."""
    most = int(np.abs(numbers).max(initial=0)) * int(np.abs(queries).max(initial=0)) * numbers.shape[1]
    if most < 1 << 62:
        return np.einsum("ij,ij->i", numbers, queries)
    limit = (1 << 63) - 1
    return np.array([max(-limit - 1, min(limit, int(x))) for x in (numbers.astype(object) * queries.astype(object)).sum(1)], np.int64)


class Group:
    """Blocks of one length that a task scans."""

    def __init__(self, blocks: pa.Table):
        self.rows = blocks.to_pylist()
        self.names = np.concatenate([(r["block"] << 10) + np.arange(len(r["ids"])) for r in self.rows])
        self.hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in self.rows])
        ids = [i for r in self.rows for i in r["ids"]]
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dim = queries.shape[1]
        parts = [bounds(np.frombuffer(r["cells"], np.uint8).reshape(-1, dim), np.frombuffer(r["grid"]).reshape(2, dim), queries) for r in self.rows]
        return np.concatenate([u for u, _ in parts], 1), np.concatenate([x for _, x in parts], 1)

    def above(self, upper: np.ndarray, lower: np.ndarray, least: float, k: int) -> np.ndarray:
        """Places of the vectors that may be among the k best, of equal vectors the k + 1 with the smallest ids."""
        if len(lower) > k:  # one of them may be the query's own row
            least = max(least, np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1])
        at = np.flatnonzero(upper >= least)
        if len(at) > 2 * k:
            at = at[np.lexsort((self.ids[at], self.null[at], self.hashes[at]))]
            h = self.hashes[at]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
            at = at[np.arange(len(h)) - first <= k]
        return at


def _scanned(blocks: DataFrame, n_blocks: int, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """query, name, upper, lower of what may be among a query's k best, by cells alone. queries: name, dim, v, least."""
    ship(blocks.sparkSession)
    tasks, groups = max(1, -(-n_blocks // BLOCKS_A_TASK)), max(1, -(-n_queries // QUERIES_A_TASK))
    left = blocks.select("block", "dim", "ids", "cells", "grid", "hashes").withColumn("b", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if some.num_rows and asked.num_rows:
            group = Group(some)
            names, least = asked.column("name").to_numpy(), asked.column("least").to_numpy()
            vectors = np.stack([np.frombuffer(x, "<i8") for x in asked.column("v").to_pylist()])
            for i in range(0, len(vectors), 32):
                for name, bar, upper, lower in zip(names[i : i + 32], least[i : i + 32], *group.bounds(vectors[i : i + 32])):
                    at = group.above(upper, lower, bar, k)
                    at = at[group.names[at] != name]
                    out.append((np.full(len(at), name), group.names[at], upper[at], lower[at]))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds)], names=["query", "name", "upper", "lower"])

    return left.groupBy("b", "q", "dim").cogroup(right.groupBy("b", "q", "dim")).applyInArrow(meet, "query long, name long, upper double, lower double")


def _kth(rows: DataFrame, score: str, k: int) -> DataFrame:
    """query, least: the kth best score of each query that has so many."""
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score)))).where(F.col("_r") <= k)
    return best.groupBy("query").agg(F.min(score).alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("query", "least")


def candidates(blocks: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates). candidates: query, name, upper of every vector that the cells can't rule out."""
    queries = written(exact_vectors(blocks.where(F.size("asked") > 0).withColumnRenamed("asked", "places")), "queries")
    n_blocks, n_queries = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    told = queries.withColumn("least", F.lit(float("-inf")))
    if n_blocks > 2 * BLOCKS_A_TASK:
        # about a task's blocks give each query a threshold to begin with; without one the scan finds the same, and returns more
        share = n_blocks // BLOCKS_A_TASK
        sample = blocks.where(F.pmod(F.xxhash64("block", F.lit(1)), F.lit(share)) == 0)
        first = _kth(_scanned(sample, 2 * BLOCKS_A_TASK, told, n_queries, k), "lower", k)
        told = queries.join(first, queries["name"] == first["query"], "left").select("name", "dim", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        told = written(told, "queries")
    found = written(_scanned(blocks, n_blocks, told, n_queries, k), "candidates")
    kept = found.join(_kth(found, "lower", k), "query", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    return queries, kept.select("query", "name", "upper")


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query, query_id, vec_id, score of pairs (query, name): reads their exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            own, other = batch.column("own").to_pylist(), batch.column("v").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                of = lambda xs: np.frombuffer(b"".join([xs[i] for i in at]), "<i8").reshape(-1, dim)
                score[at] = inner(of(other), of(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "query_id", "vec_id")), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    asked = queries.select(F.col("name").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("own"))
    rows = pairs.select("query", "name").join(vectors.select("name", F.col("id").alias("vec_id"), "dim", "v"), "name").join(asked, "query")
    return on_batches(rows.select("query", "query_id", "vec_id", "dim", "own", "v"), run, "query long, query_id long, vec_id long, score long")


def search(blocks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the queries that the file was built with."""
    queries, left = candidates(blocks, k)
    # each task of the map side keeps a query's best only, so a query with many candidates isn't dealt to one task whole
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "name")
    most, found = AHEAD * k, None
    read = written(left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query", "name"), "read")
    while True:
        scores = written(_scored(read, queries, exact_of(blocks, read)), "scores")
        found = scores if found is None else found.unionByName(scores)
        certain = _kth(found, "score", k)
        left = left.join(certain, "query", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query", "name", "upper")
        left = written(left.join(read, ["query", "name"], "left_anti"), "candidates")
        if left.isEmpty():
            break
        most *= GROWTH
        read = written(left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query", "name"), "read")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by `every`."""
    return search(build(vectors, scale, id_col, vector_col, F.col("id") % every == 0), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product([x::DOUBLE for x in q.e], [x::DOUBLE for x in c.e]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
