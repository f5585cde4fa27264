"""Vector codes by Lloyd's algorithm with filtering.

Components become integers floor(scale * x); a vector is cut into PARTS consecutive parts (of a length that isn't a multiple,
at floor(length * i / PARTS)). Each part position has a codebook, which starts as that part of the vectors with the smallest
ids. A round gives every part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces an entry
by the componentwise floor(sum / count) of its parts; an entry without parts stays.

1. Every partition packs its vectors in blocks, without a shuffle, and builds a kd-tree over each part position of a block:
   the order of the points, and for each node its bounding box and the sum of its points. Trees are written once.
2. A round sends all entries down each tree. At a node the entry nearest to the middle of the box is held against the others: one
   that is farther from every point of the box goes. When one is left, the node's sum and count are added to it and the subtree is
   done; what several reach at the leaves is compared point by point. All of it is integer arithmetic, so pruning changes nothing.
3. Sums and counts by entry and component are added up by Spark. Only codebooks come to the driver.

Vectors that are null or hold a null or non-finite component are dropped. Vectors of different lengths have codebooks of their own, and
are never compared; an empty vector has empty parts, so its code is zeros and its error 0. Rows that repeat count each; a null id comes
after all others; of equal ids the smaller vector comes first. With fewer vectors than entries there are as many entries as vectors.
Components are held within 62 bits, errors and their sums within 64. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import on_batches, written
from marketloom.llm.vectors import rows_of, sound

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block, and most points of a leaf.
BLOCK, LEAF = 16384, 32
#: Most bytes of all codebooks together: a table has one set for each length of its vectors.
MOST_BOOKS = 256 << 20
_LIMIT = (1 << 63) - 1


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(np.asarray(x, np.float64) * scale), -(2.0**62), 2.0**62).astype(np.int64)


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Where the nodes of each level begin and end in the order of a tree of n points; nodes are halved until all are leaves."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        edges = out[-1]
        halved = np.empty(2 * len(edges) - 1, np.int64)
        halved[::2], halved[1::2] = edges, (edges[:-1] + edges[1:]) // 2
        out.append(halved)
    return out


@dataclass
class Tree:
    """Points in the tree's order (`order`: their places in the block), and low, high, sums of each level's nodes."""

    order: np.ndarray
    points: np.ndarray
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def _cached(order: np.ndarray, points: np.ndarray, edges: list[np.ndarray]) -> Tree:
    starts = edges[-1][:-1]
    low, high, sums = ([f.reduceat(points, starts, axis=0)] for f in (np.minimum, np.maximum, np.add))
    for _ in edges[1:]:
        low.append(np.minimum(low[-1][::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][::2], high[-1][1::2]))
        sums.append(sums[-1][::2] + sums[-1][1::2])
    return Tree(order, points, edges, low[::-1], high[::-1], sums[::-1])


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over rows: nodes are halved at the median of their widest component."""
    order, edges = np.arange(len(points)), levels(len(points), leaf)
    if points.shape[1]:
        for level in edges[:-1]:
            for a, b in zip(level[:-1], level[1:]):
                own = points[order[a:b]]
                order[a:b] = order[a:b][np.argsort(own[:, (own.max(0) - own.min(0)).argmax()], kind="stable")]
    return _cached(order, points[order], edges)


def exact_floats(dim: int, most: int) -> bool:
    """Whether doubles hold every number that the comparison of such components can meet."""
    return 16 * max(dim, 1) * (most + 1) ** 2 < 1 << 53


def filtered(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each point in the tree's order, sums, counts by entry, distances taken)."""
    n, dim = tree.points.shape
    k = len(book)
    most = max(int(abs(tree.points).max(initial=0)), int(abs(book).max(initial=0)))
    entry, taken = np.zeros(n, np.int64), 0
    kind = np.float64 if exact_floats(dim, most) else object
    book = book.astype(kind)
    square = (book * book).sum(1) if dim else np.zeros(k)
    sums, counts = np.zeros((k, dim), kind if kind is object else np.int64), np.zeros(k, np.int64)
    if kind is object:  # beyond doubles: Python's integers, point by point
        for i, p in enumerate(tree.points.astype(object)):
            entry[i] = int(np.argmin(((book - p) ** 2).sum(1)))
            sums[entry[i]] += p
        return entry, sums, np.bincount(entry, minlength=k), n * k
    at, alive = np.array([0]), np.ones((1, k), bool)
    own = np.zeros(n, bool)  # points that were compared one by one
    for depth, edges in enumerate(tree.edges):
        low, high = tree.low[depth][at].astype(kind), tree.high[depth][at].astype(kind)
        far = np.where(alive, 4 * square - 4 * ((low + high) @ book.T), np.inf)
        best = far.argmin(1)
        node, z = np.nonzero(alive)
        b = best[node]
        u = book[z] - book[b]
        # how much farther z is than b where the box favours z most
        gap = square[z] - square[b] - 2 * (np.maximum(u, 0) * high[node] + np.minimum(u, 0) * low[node]).sum(1)
        taken += len(node)
        alive[node, z] = (z == b) | (gap < 0) | ((gap == 0) & (z < b))
        single = alive.sum(1) == 1
        for i in np.flatnonzero(single):
            a, e = edges[at[i]], edges[at[i] + 1]
            entry[a:e] = best[i]
            counts[best[i]] += e - a
            sums[best[i]] += tree.sums[depth][at[i]]
        at, alive = at[~single], alive[~single]
        if not len(at):
            break
        if depth + 1 < len(tree.edges):
            at, alive = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(alive, 2, 0)
            continue
        for i, choice in zip(at, alive):
            some = np.flatnonzero(choice)
            a, e = edges[i], edges[i + 1]
            entry[a:e] = some[(square[some] - 2 * (tree.points[a:e].astype(kind) @ book[some].T)).argmin(1)]
            own[a:e], taken = True, taken + (e - a) * len(some)
    if own.any():
        to, points = entry[own], tree.points[own]
        counts += np.bincount(to, minlength=k)
        for j in range(dim):
            sums[:, j] += np.bincount(to, points[:, j], k).astype(np.int64)
    return entry, sums, counts, taken


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    v = vectors[vector_col].cast("array<double>")
    return vectors.where(sound(v)).select(vectors[id_col].cast("long").alias("id"), label.alias("label"), v.alias("v"))


def plant(rows: DataFrame, scale: float = 1024.0, parts: int = PARTS) -> DataFrame:
    """Blocks of vectors of one length with their trees, as a written table. rows: id, label, v."""
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        label = None

        def block(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            numbers = np.stack([x for _, _, x in own])
            most = int(abs(numbers).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            summed = most < (1 << 62) // len(numbers)  # else sums are taken again when they are needed
            grown = [grow(numbers[:, a:b]) for a, b in zip(cuts(dim, parts), cuts(dim, parts)[1:])]
            pack = lambda what, kind: b"".join(x.astype(kind).tobytes() for t in grown for x in getattr(t, what))
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()), "kind": pa.array([kind]), "ids": pa.array([[i for i, _, _ in own]], pa.list_(pa.int64())), "labels": pa.array([[x for _, x, _ in own]], pa.list_(label)),
                    "orders": pa.array([np.concatenate([t.order for t in grown]).astype("<i4").tobytes()], pa.binary()), "points": pa.array([b"".join(t.points.astype(kind).tobytes() for t in grown)], pa.binary()),
                    "low": pa.array([pack("low", kind)], pa.binary()), "high": pa.array([pack("high", kind)], pa.binary()), "sums": pa.array([pack("sums", "<i8") if summed else b""], pa.binary()),
                }
            )

        for batch in batches:
            label = batch.column("label").type
            for i, x, v in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), rows_of(batch.column("v"))):
                own = held.setdefault(len(v), [])
                own.append((i, x, whole(v, scale)))
                if len(own) == BLOCK:
                    yield block(len(v))
        for dim in sorted(held):
            yield block(dim)

    return written(on_batches(rows, run, f"dim int, kind string, ids array<long>, labels array<{label_type}>, orders binary, points binary, low binary, high binary, sums binary"), "trees")


def _trees(r: dict, parts: int) -> Iterator[Tree]:
    """The trees of a block as plant() wrote it."""
    n, dim, kind, edges = len(r["ids"]), r["dim"], np.dtype(r["kind"]), levels(len(r["ids"]))
    orders, points = np.frombuffer(r["orders"], "<i4").reshape(parts, n), np.frombuffer(r["points"], kind)
    at = node = 0
    for order, a, b in zip(orders, cuts(dim, parts), cuts(dim, parts)[1:]):
        own = points[at : at + n * (b - a)].reshape(n, b - a)
        at += own.size
        if r["sums"] or b == a:
            cached: dict[str, list[np.ndarray]] = {"low": [], "high": [], "sums": []}
            begin = node
            for what, k in (("low", kind), ("high", kind), ("sums", np.dtype("<i8"))):
                node = begin
                for e in edges:
                    size = (len(e) - 1) * (b - a)
                    cached[what].append(np.frombuffer(r[what], k, size, node * k.itemsize).reshape(len(e) - 1, b - a))
                    node += size
            yield Tree(order, own, edges, **cached)
        else:
            node += sum((len(e) - 1) * (b - a) for e in edges)
            yield _cached(order, own.astype(object), edges)


Books = dict[int, list[np.ndarray]]


def _start(rows: DataFrame, scale: float, entries: int, parts: int) -> Books:
    """The parts of the vectors with the smallest ids, for each length; a task hands on as many rows of a length at most."""
    lengths = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().limit(MOST_BOOKS // (8 * entries)).collect()]
    if sum(lengths) * entries * 8 > MOST_BOOKS or len(lengths) == MOST_BOOKS // (8 * entries):
        raise ValueError(f"the codebooks of {len(lengths)} lengths of vectors take more than {MOST_BOOKS} bytes")
    order = Window.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("id"), "v")
    first = rows.select("id", "v", F.row_number().over(order).alias("r")).where(F.col("r") <= entries)
    found: dict[int, list] = {d: [] for d in lengths}
    for r in sorted(first.select("v", "r").collect(), key=lambda r: r["r"]):
        found[len(r["v"])].append(whole(np.array(r["v"], np.float64), scale))
    return {d: [np.stack(x)[:, a:b] for a, b in zip(cuts(d, parts), cuts(d, parts)[1:])] for d, x in found.items()}


def _gathered(trees: DataFrame, books: Books, parts: int) -> DataFrame:
    """dim, part, entry, place, n, total: what one round gives to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for part, tree in enumerate(_trees(r, parts)):
                    _, sums, counts, _ = filtered(tree, books[r["dim"]][part])
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([r["dim"]] * len(used), pa.int32()), "part": pa.array([part] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array([[Decimal(int(x)) for x in sums[i]] for i in used], pa.list_(pa.decimal128(38, 0)))}
                    )

    told = on_batches(trees.drop("labels"), run, "dim int, part int, entry int, n long, sums array<decimal(38,0)>")
    return told.select("dim", "part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").cast("decimal(38,0)").alias("total"))


def fit(rows: DataFrame, trees: DataFrame, scale: float = 1024.0, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> Books:
    books = _start(rows, scale, entries, parts)
    for _ in range(rounds if books else 0):
        books = {d: [b.copy() for b in x] for d, x in books.items()}
        for r in _gathered(trees, books, parts).collect():
            books[r["dim"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def books_digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in book for x in b.ravel()).encode()).hexdigest()


def encode(trees: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every vector."""
    digests = {d: books_digest(b) for d, b in books.items()}
    label_type = trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, r in enumerate(batch.to_pylist()):
                n, code, error = len(r["ids"]), [], 0
                for part, tree in enumerate(_trees(r, parts)):
                    book = books[r["dim"]][part]
                    entry = np.empty(n, np.int64)
                    entry[tree.order] = by_tree = filtered(tree, book)[0]
                    kind = np.int64 if exact_floats(r["dim"], max(int(abs(tree.points).max(initial=0)), int(abs(book).max(initial=0)))) else object
                    off = np.zeros(n, kind)
                    off[tree.order] = ((tree.points.astype(kind) - book[by_tree].astype(kind)) ** 2).sum(1)
                    code.append(entry)
                    error = error + off
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": pa.array(r["ids"], pa.int64()), "label": batch.column("labels")[row].values, "code": ["".join(f"{x:02x}" for x in xs) for xs in zip(*(c.tolist() for c in code))], "error": pa.array([min(int(x), _LIMIT) for x in error], pa.int64()), "codebooks_sha256": [digests[r["dim"]]] * n}
                )

    return on_batches(trees, run, f"vec_id long, label {label_type}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, scale: float = 1024.0, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code, error, label_error (of all vectors with the same label), codebooks_sha256."""
    rows = _vectors(vectors, id_col, vector_col, vectors[label_col] if label_col else F.lit(None).cast("int"))
    trees = plant(rows, scale)
    codes = written(encode(trees, fit(rows, trees, scale, entries, rounds)), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LIMIT)).cast("decimal(38,0)")).cast("long")
    by_label = written(codes.groupBy("label").agg(total.alias("label_error")), "label-errors")
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["label"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for 64 components: a brute-force comparison of every part with every entry, in each round."""
    sql = """
WITH v AS (SELECT vec_id, label, [CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, i AS part, e[i * len(e) // 4 + 1 : (i + 1) * len(e) // 4] AS e FROM v, range(4) t(i)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e FROM p QUALIFY entry < 256),
"""
    for k in range(rounds + 1):
        sql += f"""n{k} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, any_value(p.e) AS e, min(CAST(list_inner_product(p.e, p.e) - 2 * list_inner_product(p.e, b.e) + list_inner_product(b.e, b.e) AS BIGINT) * 256 + b.entry) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL),
"""
        if k < rounds:
            sql += f"""u{k} AS (SELECT part, m % 256 AS entry, j, floor(sum(e[j + 1]) / count(*)) AS x FROM n{k}, range(len(e)) t(j) GROUP BY ALL),
w{k} AS (SELECT part, entry, list(x ORDER BY j) AS e FROM u{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(w.e, b.e) AS e FROM b{k} b LEFT JOIN w{k} w ON b.part = w.part AND b.entry = w.entry),
"""
    return (
        sql
        + f"""h AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) for x in e], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM n{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
    )


ORACLE = oracle()
