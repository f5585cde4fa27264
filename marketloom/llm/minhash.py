"""Near-duplicate classes by DartMinHash.

A text is a weighted set of five-word shingles, each weighted by its count. Darts are thrown at the plane of weight and
rank: each unit cell of an element gets a number of darts (Poisson, mean 1) and their places from hashes of the cell alone,
so equal regions of two texts get equal darts. A text keeps the darts below its weights and below a rank bound of
t / total weight, with t = k ln k + 2 k, which is about t darts whatever its length; each dart falls into one of k
coordinates, and the earliest by rank is the coordinate's value. A text with an empty coordinate doubles its bound. Two
texts agree in a coordinate with the probability of their weighted Jaccard index.

1. Texts are named by 128-bit digests, and exact copies collapse, before any shuffle of signatures.
2. Texts that agree in a band of coordinates meet in a bucket. A bucket links its texts to its least one: as many links as
   members, not pairs. Components of these links hold every pair of texts that share a band.
3. Within each component texts are compared exactly (weighted Jaccard of at least `least`). A component is compared
   through pivots: a text is counted against all others by an inverted index of cells, until no two components hold texts
   that neither has been a pivot. That finds exactly the classes that all pairs would give, with few pivots where texts
   are alike. A component that is too large for a task is cut into parts. First each part is compared so with the
   first part, which joins nearly all of a family of texts in one class; then the texts outside the largest class, cut into parts
   too, are compared with every part, since two texts of one class need no comparison. Their links go through components.

Null text and text without words stand alone. Rows with the same id and text are one document and share a class.
class_id is the least doc_id of a class (null ids last). Other columns are left out. Very long texts are hashed whole, in pieces; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import digest, on_batches, small_batches, texts_of, written
from marketloom.llm.components import components
from marketloom.llm.shingles import mix, shingle_cells

BANDS, ROWS = 20, 5
LEAST = 0.8
#: What is compared at a time: texts, texts in the second step, and bytes of text. Components beyond it are cut; the classes are
#: the same.
MOST_TEXTS, MOST_REST, MOST_BYTES = 4000, 4000, 24 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def weighted_cells(names: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, cell, fill) of elements with real weights: a cell for each unit of weight, the last one filled in part."""
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(names)), units)
    number = np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        cells = mix(names[element] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return element, cells, np.minimum(1.0, weights[element] - number)


def signatures(doc: np.ndarray, cells: np.ndarray, n: int, k: int = BANDS * ROWS, block: int = 1 << 18, fill: np.ndarray | None = None) -> np.ndarray:
    """A row of k numbers for each of n texts, from its cells (sorted by text); zeros for a text without any. fill: how much of
    each cell is the element's, all of it where not given. Darts are thrown at a block of cells at a time."""
    out = np.zeros(n * k, np.uint64)
    size = np.bincount(doc, fill, minlength=n)
    bound = np.where(size > 0, (k * math.log(k) + 2 * k) / np.maximum(size, 1e-9), 0)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        mine = np.flatnonzero(np.isin(doc, todo)) if len(todo) < n else np.arange(len(doc))
        best = np.full(n * k, np.inf)
        most = max(1, int(block / max(1.0, bound[todo].max() + 1))) if len(mine) > block else len(mine)
        for i in range(0, len(mine), most):
            at = mine[i : i + most]
            slot, rank, name = _darts(doc[at], cells[at], bound, k, None if fill is None else fill[at])
            order = np.lexsort((rank, slot))
            slot, rank, name = slot[order], rank[order], name[order]
            first = np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)]
            slot, rank, name = slot[first], rank[first], name[first]
            better = rank < best[slot]
            best[slot[better]], out[slot[better]] = rank[better], name[better]
        todo = todo[~np.isfinite(best).reshape(n, k)[todo].all(1)]
        bound[todo] *= 2
    return out.reshape(n, k)


def _darts(d: np.ndarray, c: np.ndarray, bound: np.ndarray, k: int, fill: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, rank, name) of the darts below the bound of each cell's text and in the filled part of the cell."""
    with np.errstate(over="ignore"):
        ranks = np.ceil(bound[d]).astype(np.int64)  # unit steps of rank
        full = np.repeat(fill, ranks) if fill is not None else None
        d, c = np.repeat(d, ranks), np.repeat(c, ranks)
        step = np.arange(len(d)) - np.repeat(np.cumsum(ranks) - ranks, ranks)
        cell = mix(c + step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        darts = np.searchsorted(_POISSON, _uniform(cell))
        d, cell, step = np.repeat(d, darts), np.repeat(cell, darts), np.repeat(step, darts)
        number = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell + (number + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        rank = step + _uniform(dart)
        keep = rank < bound[d]
        if full is not None:
            keep &= _uniform(mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))) < np.repeat(full, darts)
        name = mix(dart[keep] + np.uint64(0xE7037ED1A0B428DB))
        return d[keep] * k + (name % np.uint64(k)).astype(np.int64), rank[keep], name


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, k = signature.shape
    rows = signature.reshape(n, bands, k // bands)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands))
    with np.errstate(over="ignore"):
        for i in range(k // bands):
            h = mix(h + rows[:, :, i])
    return h.view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, bytes, bands of every row; bands are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=2 << 20):
            raws = [x.encode("utf-8", "surrogatepass") for x in texts_of(batch)]
            doc, cells = shingle_cells(raws)
            keys = band_keys(signatures(doc, cells, len(raws))).tolist()
            some = np.bincount(doc, minlength=len(raws)) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(map(len, raws), pa.int64()), pa.array([k if s else None for k, s in zip(keys, some)], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "bytes", "bands"],
            )

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    return on_batches(rows, run, "doc_id long, digest binary, bytes long, bands array<long>")


def linked(texts: list[bytes], least: float = LEAST, known: list[bytes | None] | None = None) -> list[int]:
    """For each text the first one of its class: classes of the graph of pairs with a weighted Jaccard index of `least`. Texts
    of equal `known` are in one class from the start."""
    n = len(texts)
    doc, cells = shingle_cells(texts)
    size = np.bincount(doc, minlength=n)
    _, cell = np.unique(cells, return_inverse=True)
    order = np.argsort(cell, kind="stable")
    holders = doc[order]  # texts by cell
    begin = np.searchsorted(cell[order], np.arange(cell.max() + 2 if len(cell) else 1))
    own = np.concatenate([[0], np.cumsum(size)])
    label, used = np.arange(n), np.zeros(n, bool)
    if known is not None:
        first: dict[bytes, int] = {}
        label = np.array([i if x is None else first.setdefault(x, i) for i, x in enumerate(known)])
    while True:
        open_in = np.unique(label[~used], return_counts=True)
        if len(open_in[0]) < 2:
            return label.tolist()
        sizes = np.bincount(label, minlength=n)[open_in[0]]
        pivot = int(np.flatnonzero(~used & (label == open_in[0][sizes.argmin()]))[0])
        used[pivot] = True
        mine = cell[own[pivot] : own[pivot + 1]]
        if not len(mine):
            continue
        spans = [holders[begin[c] : begin[c + 1]] for c in mine.tolist()]
        shared = np.bincount(np.concatenate(spans), minlength=n)
        near = np.flatnonzero(shared >= least * (size[pivot] + size - shared) - 1e-9)
        near = near[(size[near] > 0)]
        groups = np.unique(label[near])
        label[np.isin(label, groups)] = groups.min()


def _compared(members: DataFrame, least: float) -> DataFrame:
    """members: root, p, q, digest, known, text. (digest, lead) by the classes of each (root, p, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, texts, labels = None, [], [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if names:
                lead = linked(texts, least, labels)
                yield pa.RecordBatch.from_pydict({"digest": pa.array(names, pa.binary()), "lead": pa.array([names[i] for i in lead], pa.binary())})

        for batch in small_batches(batches):
            for root, p, q, name, known, text in zip(*(batch.column(c).to_pylist() for c in ("root", "p", "q", "digest", "known", "text"))):
                if (root, p, q) != key:
                    yield from ended()
                    key, names, texts, labels = (root, p, q), [], [], []
                if not names or names[-1] != name:  # rows that repeat come together
                    names.append(name)
                    labels.append(known)
                    texts.append(text.encode("utf-8", "surrogatepass"))
        yield from ended()

    dealt = members.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "digest")
    return on_batches(dealt, run, "digest binary, lead binary")


def classes(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", most_texts: int = MOST_TEXTS, most_rest: int = MOST_REST, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: doc_id, digest of each row. texts: digest, first_id, lead, class_id of each text with words;
    lead is the digest of the text that stands for the class."""
    rows = written(sketch(docs, id_col, text_col), "sketch")
    texts = rows.where("bands is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    texts = written(texts, "texts")
    met = texts.select("digest", F.explode("bands").alias("bucket"))
    least_in = met.groupBy("bucket").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that both sides of the join are dealt anew and a hot bucket's partition can be split
    links = met.join(written(least_in, "buckets"), "bucket").where("digest <> least").select("digest", "least").distinct()
    members = components(links, "digest", "least").withColumnRenamed("node", "digest").join(texts.drop("bands"), "digest")
    parts_of = lambda rows, most: rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum("bytes") / F.lit(most_bytes))).cast("int").alias("parts"))
    members = written(members.join(written(parts_of(members, most_texts), "sizes"), "root").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")), "members")
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].cast("long").alias("first_id"), text.alias("text"), digest(text).alias("digest"))

    def compared(placed: DataFrame) -> DataFrame:
        # merged at every size of the table: texts are dealt by digest whether or not the members would fit in a broadcast
        shown = source.alias("s").join(placed.hint("merge").alias("m"), (F.col("s.digest") == F.col("m.digest")) & F.col("s.first_id").eqNullSafe(F.col("m.first_id"))).select("m.root", "m.p", "m.q", "m.digest", "m.known", "s.text")
        return written(_compared(shown, least), "compared")

    q = F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part")))
    unknown = F.lit(None).cast("binary").alias("known")
    pairs = compared(members.select("digest", "first_id", "root", F.lit(0).alias("p"), q.alias("q"), unknown))
    if members.where("parts > 1").isEmpty():
        pairs = pairs.withColumnRenamed("lead", "group")
    else:  # a text of the first part stands in several pairs
        grouped = lambda links: members.select("digest").join(components(links, "digest", "lead").withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("root", "digest").alias("group"))
        large = members.where("parts > 1").join(grouped(pairs).withColumnRenamed("group", "known"), "digest")
        largest = large.groupBy("root", "known").count().groupBy("root").agg(F.max_by("known", F.struct("count", "known")).alias("largest"))
        large = written(large.drop("parts", "part").join(written(largest, "largest"), "root"), "large")
        rest = large.where("known <> largest")
        sizes = parts_of(rest, most_rest).withColumnRenamed("parts", "rest_parts").join(parts_of(large, most_rest), "root")
        sizes = written(sizes, "sizes")  # of components in which something is left
        large = large.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
        rest = rest.join(sizes, "root")
        some = rest.withColumn("p", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("rest_parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        every = large.withColumn("q", F.col("part")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
        cols = ("digest", "first_id", "root", "p", "q", "known")
        pairs = grouped(pairs.unionByName(compared(some.select(*cols).unionByName(every.select(*cols)))))
    named = texts.select("digest", "first_id").join(pairs, "digest", "left").select("digest", "first_id", F.coalesce("group", "digest").alias("group"))
    named = written(named, "named")
    lead = named.groupBy("group").agg(F.min(F.struct(F.col("first_id").isNull().alias("z"), "first_id", "digest")).alias("m"))
    return rows.select("doc_id", "digest", F.col("bands").isNotNull().alias("worded")), named.join(lead, "group").select("digest", "first_id", F.col("m.digest").alias("lead"), F.col("m.first_id").alias("class_id"))


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of every row."""
    rows, texts = classes(docs, least, id_col, text_col)
    found = rows.join(texts, "digest", "left")
    return found.select("doc_id", F.when(F.col("worded") & F.col("lead").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each class the row with the least id stays, with all its columns. Rows without
    words stay."""
    rows, texts = classes(docs, least, id_col, text_col)
    lead = texts.where("digest = lead").select(F.col("digest").alias("_digest"), F.col("first_id").alias("_first"))
    worded = rows.where("worded").select("doc_id", "digest")
    repeated = worded.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count() > 0
    # rows travel as one struct, so no column of theirs can clash with a work column
    own_id, own_text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`").cast("string")
    marked = docs.select(F.struct(*docs.columns).alias("row")).withColumn("_digest", digest(own_text))
    has_words = F.coalesce(own_text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    with_words = marked.where(has_words).join(lead, "_digest").where(own_id.eqNullSafe(F.col("_first"))).drop("_first")
    if repeated:
        with_words = with_words.withColumn("_id", own_id).dropDuplicates(["_id", "_digest"]).drop("_id")
    return with_words.unionByName(marked.where(~has_words)).select("row.*")
