"""Quality classifier by co-training.

Two views of a document: its text (shares of bytes, of letter cases, of symbols and of repeats) and its metadata (language,
source, length as the table has it). A logistic model is fitted to each view from labelled rows. Over rounds each model
labels the rows of an unlabelled pool that it is most confident of, in the classes' proportion, and these pseudo-labels
join the training rows of the other model. Rows set aside calibrate each model (Platt) and fit the weights that join the two
calibrated views. Every row is then scored.

Training reads a bounded sample: about `most_labelled` labelled documents and `most_pool` others, chosen by hashes of id and
text, so that an id or a text that fills a third of all rows can't fill it: rows of equal id and text count once. Only their
feature vectors reach the driver. A label that occurs more than once counts by its mean. Null or empty text and
null metadata have features of their own. Rows repeat as in the input. Without labels of both classes every score is 0.5
and every row is accepted. Other columns are left out. Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import digest, on_batches, small_batches

ROUNDS, SHARE_A_ROUND, SURE = 4, 0.1, 0.95
MOST_LABELLED, MOST_POOL = 6000, 6000
#: Rows that are likelier bad than this says are rejected.
THRESHOLD = 0.5
SLOTS = 32
_LETTERS, _ASCII = string.ascii_letters.encode(), re.compile(r"[\x00-\x7f]+")


def letter_count(text: str, raw: bytes) -> int:
    """Letters of any script; raw: the text's bytes, which count those of ASCII faster."""
    ascii_ = len(raw) - len(raw.translate(None, _LETTERS))
    return ascii_ if text.isascii() else ascii_ + sum(map(str.isalpha, _ASCII.sub("", text)))


def text_view(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bytes_ = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n)
    k = max(1, len(words))
    letters = max(1, letter_count(text or "", raw))
    upper = sum(raw.count(bytes([c])) for c in range(65, 91))
    first = sum(w[:1].isupper() for w in words)
    more = [
        math.log1p(len(words)) / 8,
        min(3.0, sum(map(len, words)) / k / 8),
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        upper / letters,
        first / k,
        sum(w.isupper() for w in words) / k,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        min(3.0, len(lines) / k * 10),
        float(not words),
        float(text is None),
    ]
    return [*more, *bytes_.tolist()]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (2 * SLOTS + 20)
    for at, value in ((0, lang), (SLOTS, source)):
        if value is not None:
            out[at + zlib.crc32(value.encode("utf-8", "surrogatepass")) % SLOTS] = 1.0
    size = math.log2(max(1, n_chars or 0))
    out[2 * SLOTS + min(16, int(size))] = 1.0
    out[-3:] = [size / 16, float(n_chars is None), float(lang is None) + float(source is None)]
    return out


class Logistic(NamedTuple):
    weights: np.ndarray  # the last is the constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.3, steps: int = 25) -> Logistic:
    """Ridge-penalised maximum likelihood by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), slope)
        w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(w)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model(NamedTuple):
    name: str
    views: tuple[Logistic, Logistic] | None
    platt: tuple[tuple[float, float], tuple[float, float]]
    joint: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good: by text, by metadata, joined."""
        if self.views is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        z = [a * v.logits(x) + b for v, x, (a, b) in zip(self.views, (text, meta), self.platt)]
        z = [np.clip(v, -30, 30) for v in z]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(np.stack([*z, np.ones(len(text))], 1) @ self.joint)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """views, y: labelled rows; pool: the views of unlabelled rows."""
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return Model(uuid.uuid4().hex, None, ((1.0, 0.0), (1.0, 0.0)), np.zeros(3))
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    held = aside if aside.any() else ~aside
    train, goal = ~aside, y[~aside].astype(float)
    # what each model has been taught by the other: rows of the pool and their labels
    taught: list[dict[int, float]] = [{}, {}]
    fitted: list[Logistic] = []
    for step in range(rounds + 1):
        fitted = []
        for k in (0, 1):
            rows = sorted(taught[k])
            x = np.concatenate([views[k][train], pool[k][rows]]) if rows else views[k][train]
            labels = np.concatenate([goal, [taught[k][i] for i in rows]]) if rows else goal
            fitted.append(fit_logistic(x, labels, np.concatenate([np.ones(len(goal)), np.full(len(rows), 0.5)])))
        if step == rounds or not len(pool[0]):
            break
        for k in (0, 1):
            p = _sigmoid(fitted[k].logits(pool[k]))
            for label, sure, share in ((1.0, p, goal.mean()), (0.0, 1 - p, 1 - goal.mean())):
                most = int(len(p) * SHARE_A_ROUND * share) + 1
                for i in np.argsort(-sure, kind="stable")[: most * (step + 1)].tolist():
                    if sure[i] >= SURE:
                        taught[1 - k].setdefault(i, label)
    platt, z = [], []
    target = y[held].astype(float)
    for k in (0, 1):
        raw = fitted[k].logits(views[k][held])
        a, b = fit_logistic(raw[:, None], target, ridge=1e-2).weights
        platt.append((float(a), float(b)))
        z.append(np.clip(a * raw + b, -30, 30))
    joint = fit_logistic(np.stack(z, 1), target, ridge=0.1)
    return Model(uuid.uuid4().hex, (fitted[0], fitted[1]), (platt[0], platt[1]), joint.weights)


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n = (batch.column(c).to_pylist() for c in _COLUMNS[1:])
    return np.array([*map(text_view, text)]), np.array([*map(meta_view, lang, source, n)])


def _rows(docs: DataFrame) -> DataFrame:
    """The columns that the views read; a missing one is null."""
    kinds = dict(zip(_COLUMNS, ("long", "string", "string", "string", "long")))
    return docs.select(*((F.col(c).cast(kinds[c]) if c in docs.columns else F.lit(None).cast(kinds[c])).alias(c) for c in _COLUMNS))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_pool: int = MOST_POOL) -> Model:
    """labels: doc_id, quality (1 good, 0 bad)."""
    mark = lambda *cs: F.pmod(F.xxhash64(*cs), F.lit(1 << 30)) / float(1 << 30)
    rows = _rows(docs)
    n = rows.select("doc_id").count()
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    share = most_labelled / max(1, known.count())
    # about most_labelled rows by construction, so broadcasting them is safe at any size of the table
    chosen = known.where(mark("doc_id", F.lit(5)) < share).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # of the rows with these ids, which may be many more, as many again by a hash of the text
    n_labelled = rows.select("doc_id").join(F.broadcast(chosen), "doc_id").count()
    own = mark("doc_id", "text", F.lit(6))
    sampled = rows.join(F.broadcast(chosen), "doc_id", "left").withColumn("y", F.when(own < 2 * most_labelled / max(1, n_labelled), F.col("y")))
    sampled = sampled.where(F.col("y").isNotNull() | (mark("doc_id", "text", F.lit(7)) < most_pool / max(1, n)))
    sampled = sampled.groupBy("doc_id", digest(F.col("text")).alias("digest")).agg(*(F.first(c).alias(c) for c in ("text", "lang", "source", "n_chars", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            text, meta = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(text.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(meta.astype(np.float32).tolist(), pa.list_(pa.float32())), batch.column("digest")], names=["doc_id", "y", "t", "m", "digest"])

    got = on_batches(sampled.select(*_COLUMNS, "y", "digest"), run, "doc_id long, y int, t array<float>, m array<float>, digest binary").toArrow().sort_by([("doc_id", "ascending"), ("digest", "ascending")])
    y = got.column("y").to_numpy(zero_copy_only=False).astype(float)
    views = [np.array(got.column(c).to_pylist(), np.float64).reshape(len(y), n) for c, n in (("t", len(text_view(None))), ("m", len(meta_view(None, None, None))))]
    has = ~np.isnan(y)
    return co_train((views[0][has], views[1][has]), y[has].astype(int), (views[0][~has], views[1][~has]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score, accepted of every row."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            text, meta, both = share.value.scores(*_views(batch))
            accepted = both >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (text, meta, both, accepted))], names=["doc_id", "text_score", "meta_score", "score", "accepted"])

    return on_batches(_rows(docs), run, "doc_id long, text_score double, meta_score double, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are rejected; all columns stay as they are, and no row moves to another task."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            view = {c: batch.column(c) if c in batch.schema.names else pa.nulls(batch.num_rows) for c in _COLUMNS}
            both = share.value.scores(*_views(pa.RecordBatch.from_pydict(view)))[2]
            yield batch.filter(pa.array(both >= threshold))

    return on_batches(docs, run, docs.schema)
