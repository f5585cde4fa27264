"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

A vector is projected on FEW directions with Gaussian components. For two vectors at distance d the squared distance of their
projections is d * d times a chi-square variable with FEW degrees of freedom. A search meets vectors in the order of their projected
distance r, takes their exact distance, and stops when r * r exceeds the `sure` quantile of that variable times the square of the kth
distance found: each neighbour that is really nearer would have come by then with probability `sure`.

1. A bounded sample of projections gives the top of a kd-tree: its cells, each a box of projections. Every vector is dealt to a block of
   its cell, by a hash where a cell has several, and each block builds a kd-tree of its own.
2. A query first searches one block of its own cell, which bounds its kth distance from above. Then it goes to the blocks of the
   cells that the stopping test doesn't rule out for that bound, and each search there begins with it.
3. The best of all blocks are the result.

Of equal vectors only the k + 1 with the smallest ids can be results; the others don't enter blocks, and equal queries are searched
for once, so a vector that a third of all rows hold costs as much as any other. Distances are exact in double precision; those beyond
its range are infinite. Vectors that are null, empty or zero or hold a null or non-finite component take no part; only vectors of a
query's length are its candidates. A query's own row is left out, once, where rows repeat; a null id comes last in ties and asks
nothing. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.shipping import ship
from marketloom.llm.common import on_batches, written
from marketloom.llm.vectors import is_single, numbers, rows_of, sound

#: Directions (an even number), and the probability with which a neighbour is met before the search stops.
FEW, SURE = 16, 0.95
#: Vectors of a block and of a leaf, cells at most, vectors of the sample for each cell, lengths of vectors that have cells.
BLOCK, LEAF, MOST_CELLS, SAMPLED, MOST_LENGTHS = 4096, 32, 4096, 16, 16
#: Queries that meet a block in one task.
QUERIES_A_TASK = 1024
#: Distinct vectors of a task among which copies are looked for at a time.
HELD = 1 << 16
_WIDEST = 1e37


def quantile(p: float, few: int = FEW) -> float:
    """The p quantile of a chi-square variable with an even number of degrees of freedom."""

    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(few // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if above((low + high) / 2) > 1 - p else (low, (low + high) / 2)
    return high


def project(vectors: np.ndarray, few: int = FEW) -> np.ndarray:
    """The same directions for every vector of a length, on every machine."""
    along = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], few))
    with np.errstate(over="ignore"):
        return np.clip(np.clip(vectors.astype(np.float64), -_WIDEST, _WIDEST) @ along, -_WIDEST, _WIDEST).astype(np.float32)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from q; scaled where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        off = rows - q
        d = np.sqrt((off * off).sum(1))
        odd = np.flatnonzero(~np.isfinite(d) | ((d < 1e-150) & off.any(1)))
        for i in odd:
            half = rows[i] / 2 - q / 2
            most = abs(half).max()
            d[i] = 2 * (most * np.sqrt(((half / most) ** 2).sum())) if np.isfinite(most) and most else most
    return d


@dataclass
class Cells:
    """The top of the tree for vectors of one length: heap-ordered splits, and for each cell its box and how many blocks it has."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        for _ in range(int(math.log2(len(self.blocks)))):
            right = projected[np.arange(len(node)), self.axis[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - (len(self.blocks) - 1)

    def near(self, projected: np.ndarray, radius2: float) -> np.ndarray:
        off = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        return np.flatnonzero((off * off).sum(1) <= radius2)


def divide(sample: np.ndarray, total: int, block: int, most: int) -> Cells:
    """Cells of about equal shares of a sample of `total` vectors, split at medians of the widest direction."""
    deep = max(0, min(int(math.log2(most)), math.floor(math.log2(max(1, min(total / block, len(sample) / SAMPLED))))))
    few = sample.shape[1]
    axis, at = np.zeros((1 << deep) - 1, np.int64), np.full((1 << deep) - 1, np.inf)
    low, high, parts = [np.full(few, -np.inf)], [np.full(few, np.inf)], [sample.astype(np.float64)]
    for depth in range(deep):
        lows, highs, halves = [], [], []
        for i, (a, b, own) in enumerate(zip(low, high, parts)):
            node = (1 << depth) - 1 + i
            if len(own):
                axis[node] = j = int((own.max(0) - own.min(0)).argmax())
                at[node] = np.median(own[:, j])
            j, t = axis[node], at[node]
            up, down = a.copy(), b.copy()
            up[j], down[j] = max(a[j], t), min(b[j], t)
            lows, highs = [*lows, a, up], [*highs, down, b]
            halves += [own[own[:, j] <= t], own[own[:, j] > t]]
        low, high, parts = lows, highs, halves
    share = np.array([len(x) for x in parts])
    expected = (share + 2 * np.sqrt(share) + 1) / max(1, len(sample)) * total
    return Cells(axis, at, np.stack(low), np.stack(high), np.maximum(1, np.ceil(expected / block)).astype(np.int64))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray]]:
    """(length, ids, vectors) of what a batch holds of each length; -0 becomes 0. Zero vectors are left out."""
    for batch in batches:
        ids, rows = batch.column("id").to_pylist(), rows_of(batch.column("v"))
        lengths = np.array([len(x) for x in rows])
        for dim in np.unique(lengths):
            at = [i for i in np.flatnonzero(lengths == dim) if rows[i].any()]
            if at:
                yield int(dim), [ids[i] for i in at], np.stack([rows[i] for i in at]) + 0


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16, key=b"%d" % len(x)).digest()


def _survey(rows: DataFrame, block: int, most_cells: int) -> dict[int, Cells]:
    """Cells for the lengths that most vectors have, from a sample of SAMPLED vectors a cell at most; other lengths are one cell."""
    counts = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    out = {}
    for dim, total in counts:
        wanted = SAMPLED * min(most_cells, max(1, total // block))
        picked = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(max(1, total // wanted))) == 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, vectors in _grouped(batches):
                yield pa.RecordBatch.from_pydict({"p": pa.array([x.tobytes() for x in project(vectors)], pa.binary())})

        sample = on_batches(picked, run, "p binary").limit(4 * wanted).collect() if dim else []
        if sample:
            out[dim] = divide(np.stack([np.frombuffer(r[0], np.float32) for r in sample]), total, block, most_cells)
    return out


def _place(cells: dict[int, Cells], dim: int, projected: np.ndarray, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, block of the cell) of vectors."""
    if dim not in cells:
        return np.zeros(len(projected), np.int64), np.zeros(len(projected), np.int64)
    cell = cells[dim].of(projected)
    return cell, np.array([int.from_bytes(h[:8], "little") for h in digests], np.uint64).astype(np.uint64) % cells[dim].blocks[cell].astype(np.uint64)


def _dealt(rows: DataFrame, cells: dict[int, Cells], k: int, single: bool) -> DataFrame:
    """dim, cell, block, id, v, p, digest of vectors; of equal ones that a task meets about the k + 1 with the smallest ids."""
    kind = np.float32 if single else np.float64
    order = lambda i: (i is None, i or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for dim, ids, vectors in _grouped(batches):
            vectors = vectors.astype(kind)
            digests, keep = [_digest(x) for x in vectors], []
            for n, (i, h) in enumerate(zip(ids, digests)):
                best = held.setdefault(h, [])
                if len(best) <= k or order(i) < best[-1]:
                    best[k:] = []
                    best.append(order(i))
                    best.sort()
                    keep.append(n)
            if len(held) > HELD:
                held = {}
            if keep:
                digests, p = [digests[n] for n in keep], project(vectors[keep])
                cell, block = _place(cells, dim, p, digests)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(keep), pa.int32()), "cell": pa.array(cell, pa.int64()), "block": pa.array(block.astype(np.int64)), "id": pa.array([ids[n] for n in keep], pa.int64()), "v": pa.array([vectors[n].tobytes() for n in keep], pa.binary()), "p": pa.array([x.tobytes() for x in p], pa.binary()), "digest": pa.array(digests, pa.binary())})

    return on_batches(rows, run, "dim int, cell long, block long, id long, v binary, p binary, digest binary")


_BLOCKS = "dim int, cell long, block long, ids array<long>, v binary, p binary, digests binary, low binary, high binary"


def _build(k: int):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        """One block: its vectors in the order of a kd-tree over projections, and the boxes of the leaves and all nodes above."""
        ids, digests = rows.column("id").to_pylist(), rows.column("digest").to_pylist()
        kept, seen = [], {}
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)):
            seen[digests[i]] = seen.get(digests[i], 0) + 1
            if seen[digests[i]] <= k + 1:
                kept.append(i)
        p = np.stack([np.frombuffer(x, np.float32) for x in rows.column("p").take(pa.array(kept)).to_pylist()])
        order, edges = np.arange(len(p)), [np.array([0, len(p)])]
        while np.diff(edges[-1]).max() > LEAF:
            for a, b in zip(edges[-1][:-1], edges[-1][1:]):
                own = p[order[a:b]]
                order[a:b] = order[a:b][np.argsort(own[:, (own.max(0) - own.min(0)).argmax()], kind="stable")]
            halved = np.empty(2 * len(edges[-1]) - 1, np.int64)
            halved[::2], halved[1::2] = edges[-1], (edges[-1][:-1] + edges[-1][1:]) // 2
            edges.append(halved)
        p = p[order]
        low, high = [f.reduceat(p, edges[-1][:-1], axis=0) for f in (np.minimum, np.maximum)]
        lows, highs = [low], [high]
        for _ in edges[1:]:
            lows.append(np.minimum(lows[-1][::2], lows[-1][1::2]))
            highs.append(np.maximum(highs[-1][::2], highs[-1][1::2]))
        at = [kept[i] for i in order]
        raw = lambda c: b"".join(rows.column(c).take(pa.array(at)).to_pylist())
        dim, cell, block = (x.as_py() for x in key)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int64()), "block": pa.array([block], pa.int64()), "ids": pa.array([[ids[i] for i in at]], pa.list_(pa.int64())), "v": pa.array([raw("v")], pa.binary()), "p": pa.array([p.tobytes()], pa.binary()),
                "digests": pa.array([b"".join(digests[i] for i in at)], pa.binary()), "low": pa.array([b"".join(x.tobytes() for x in lows[::-1])], pa.binary()), "high": pa.array([b"".join(x.tobytes() for x in highs[::-1])], pa.binary()),
            }
        )

    return build


class Block:
    def __init__(self, r: dict, single: bool):
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in r["ids"]], np.int64)
        n, few = len(self.ids), FEW
        self.v = np.frombuffer(r["v"], np.float32 if single else np.float64).reshape(n, r["dim"])
        self.p = np.frombuffer(r["p"], np.float32).reshape(n, few).astype(np.float64)
        self.digests = [r["digests"][i : i + 16] for i in range(0, 16 * n, 16)]
        self.edges = [np.array([0, n])]
        while np.diff(self.edges[-1]).max() > LEAF:
            e = self.edges[-1]
            halved = np.empty(2 * len(e) - 1, np.int64)
            halved[::2], halved[1::2] = e, (e[:-1] + e[1:]) // 2
            self.edges.append(halved)
        boxes = [np.frombuffer(r[c], np.float32).reshape(-1, few).astype(np.float64) for c in ("low", "high")]
        at = np.cumsum([0, *(len(e) - 1 for e in self.edges)])
        self.low, self.high = ([b[x:y] for x, y in zip(at, at[1:])] for b in boxes)

    def search(self, q: np.ndarray, p: np.ndarray, k: int, bound: float, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distances, vectors verified) of the k nearest that are met before the test stops the search."""
        radius2, node = factor * bound * bound, np.array([0])
        for depth, edges in enumerate(self.edges):
            off = np.maximum(np.maximum(self.low[depth][node] - p, p - self.high[depth][node]), 0)
            node = node[(off * off).sum(1) <= radius2]
            if depth + 1 < len(self.edges):
                node = np.stack([2 * node, 2 * node + 1], 1).ravel()
        edges = self.edges[-1]
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in node]) if len(node) else np.zeros(0, np.int64)
        off = self.p[at] - p
        r2 = (off * off).sum(1)
        order = np.argsort(r2, kind="stable")
        at, r2 = at[order], r2[order]
        best, d = np.zeros(0, np.int64), np.zeros(0)
        begin, size = 0, 2 * k
        while begin < len(at) and not r2[begin] > factor * bound * bound:
            some = at[begin : begin + size]
            best, d = np.concatenate([best, some]), np.concatenate([d, distances(self.v[some].astype(np.float64), q)])
            first = np.lexsort((self.ids[best], d))[:k]
            best, d = best[first], d[first]
            if len(d) == k:
                bound = min(bound, d[-1])
            begin, size = begin + size, min(2 * size, 256)
        return best, d, min(begin, len(at))


_ASKED = "digest binary, dim int, cell long, block long, v binary, p binary, least double"


def _searched(blocks: DataFrame, asked: DataFrame, n_asked: int, k: int, factor: float, single: bool) -> DataFrame:
    """digest (of the query), id, score, same, verified: of each query the k nearest of each block that it is sent to. A block that many
    queries ask for is sent to several tasks."""
    ship(blocks.sparkSession)
    keys = ["dim", "cell", "block", "g"]
    asked = asked.withColumn("g", F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-n_asked // QUERIES_A_TASK)))).cast("int"))
    needed = blocks.join(asked.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct(), F.expr("dim = _dim AND cell = _cell AND block = _block"))
    needed = needed.select(*blocks.columns, F.col("_g").alias("g"))

    def meet(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("digest", "id", "score", "same", "verified")}
        if block.num_rows:
            own = Block(block.slice(0, 1).to_pylist()[0], single)
            for r in queries.to_pylist():
                at, d, n = own.search(np.frombuffer(r["v"], np.float32 if single else np.float64).astype(np.float64), np.frombuffer(r["p"], np.float32).astype(np.float64), k, r["least"], factor)
                out["digest"] += [r["digest"]] * len(at)
                out["id"] += [None if i == np.iinfo(np.int64).max else int(i) for i in own.ids[at]]
                out["score"] += d.tolist()
                out["same"] += [own.digests[i] == r["digest"] for i in at]
                out["verified"] += [n] * len(at)
        kinds = {"digest": pa.binary(), "id": pa.int64(), "score": pa.float64(), "same": pa.bool_(), "verified": pa.int64()}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    return needed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "digest binary, id long, score double, same boolean, verified long")


def _routed(asked: DataFrame, cells: dict[int, Cells], factor: float) -> DataFrame:
    """A row for each block that a query must visit, given the bound of its kth distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = cells.get(r["dim"])
                near = [(0, 1)] if own is None else [(c, own.blocks[c]) for c in own.near(np.frombuffer(r["p"], np.float32).astype(np.float64), factor * r["least"] * r["least"])]
                where = [(int(c), b) for c, n in near for b in range(int(n))]
                for i in range(0, len(where), 1024):
                    some = where[i : i + 1024]
                    yield pa.RecordBatch.from_pydict({c: pa.array([r[c]] * len(some), batch.schema.field(c).type) for c in ("digest", "dim")} | {"cell": pa.array([c for c, _ in some], pa.int64()), "block": pa.array([b for _, b in some], pa.int64())} | {c: pa.array([r[c]] * len(some), batch.schema.field(c).type) for c in ("v", "p", "least")})

    return on_batches(asked.select("digest", "dim", "v", "p", "least"), run, _ASKED)


def search(vectors: DataFrame, every: int = 100, k: int = 10, sure: float = SURE, block: int = BLOCK, most_cells: int = MOST_CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose id is divisible by `every`."""
    v = numbers(vectors, vector_col)
    single = is_single(vectors, vector_col)
    rows = vectors.where(sound(vectors[vector_col].cast("array<double>"))).select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    factor = quantile(sure)
    cells = _survey(rows, block, most_cells)
    ship(vectors.sparkSession)
    blocks = written(_dealt(rows, cells, k, single).groupBy("dim", "cell", "block").applyInArrow(_build(k), _BLOCKS), "blocks")
    # each copy of a query row asks; a task gives only some of equal rows, so copies are counted before
    wanted = _asking(rows.where(F.col("id") % every == 0), single)
    wanted = written(wanted.groupBy("id", "digest").agg(F.count("*").alias("n")), "wanted")
    asked = _dealt(rows.where(F.col("id") % every == 0), cells, 0, single).dropDuplicates(["digest"])
    asked = written(asked.select("digest", "dim", "cell", "block", "v", "p", F.lit(float("inf")).alias("least")), "asked")
    n_asked = asked.count()
    near = _searched(blocks, asked, n_asked, k + 1, factor, single).groupBy("digest").agg(F.max("score").alias("d"), F.count("*").alias("n")).where(F.col("n") > k)
    asked = asked.drop("least").join(near, "digest", "left").select("digest", "dim", "v", "p", F.coalesce("d", F.lit(float("inf"))).alias("least"))
    routed = _routed(written(asked, "asked"), cells, factor)
    return _ranked(wanted, written(_searched(blocks, routed, n_asked, k + 1, factor, single), "found"), k)


def _asking(rows: DataFrame, single: bool) -> DataFrame:
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, vectors in _grouped(batches):
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "digest": pa.array([_digest(x) for x in vectors.astype(kind)], pa.binary())})

    return on_batches(rows, run, "id long, digest binary")


def _ranked(wanted: DataFrame, found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("digest").orderBy("score", F.asc_nulls_last("id"))
    first = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = written(first.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score", "same"))).alias("best")), "best")
    rows = wanted.join(lists, "digest").select("id", "n", "best")
    own = F.array_position(F.transform("best", lambda x: F.coalesce(x["same"] & (x["id"] == F.col("id")), F.lit(False))), True)
    rest = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    rows = rows.withColumn("own", own).select("id", F.explode(F.expr("sequence(1, n)")), rest.alias("best"))
    return rows.select(F.col("id").alias("query_id"), F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
