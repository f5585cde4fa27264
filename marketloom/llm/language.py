"""Language identification by unigram pieces with all segmentations summed.

The pieces are those of a fixed public vocabulary; for each language only their probabilities are learnt. A word's
probability in a language is the sum over all ways to cut it into pieces, found by the forward algorithm; a text's is the
product over its words (no piece spans white space). Probabilities are fitted by expectation maximisation: the
forward-backward pass gives each piece's expected count over all segmentations of the training words.

Training uses a bounded sample: about `per_lang` texts of each language, chosen by a hash of the text, so that an id or a
text that fills a third of all rows counts once; each is read whole, and what reaches the driver are its word counts. A
letter is a character of a general category L. Every row is scored. Null text, or text without a letter, is `und` with
score 0. Rows repeat as they do in the input; other columns are left out. With no training rows all is `und`; an empty table gives
no rows. At most MOST_LANGS languages are learnt, since the model grows with them; every row is scored all the same.

Words of up to SHORT letters are taken many at a time, longer ones one by one with sums that are divided as they go; both
give the same number.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import digest, on_batches, small_batches, texts_of, written

ROUNDS = 3
SHORT, SCALE = 48, 64.0  # SCALE a letter keeps the products of a word's probabilities in range
#: What a worker keeps of words that it has scored.
MOST_WORDS, MOST_LETTERS = 700_000, 32 << 20
#: How many languages are learnt: those with most training rows, ties to the first by code point. It bounds the model, which every
#: task holds: a number for each piece and language, about 70 MB in all at 256 languages of 33,000 pieces.
MOST_LANGS = 256


def pieces_of(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model, in its order, lower-cased and without repeats."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return list(dict.fromkeys(p.lower() for p in found ))


_RUNS, _ASCII_RUNS = regex.compile(r"\p{L}+").findall, regex.compile("[a-z]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    return _ASCII_RUNS(text) if text.isascii() else _RUNS(text)


class PieceTable:
    """Finds pieces among many substrings at once: 64-bit rolling hashes, looked up in tables of 2 ** BITS slots. A piece
    whose slot is taken goes to the next table, which reads other bits."""

    BITS, FACTOR = 18, 0x9E3779B97F4A7C15

    def __init__(self, pieces: list[str]):
        of_length: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(pieces):
            of_length[len(p)].append(i)
        self.longest = max(of_length, default=1)  # letters of a piece
        self.hashes = np.zeros(len(pieces) + 1, np.uint64)  # the last: no piece
        for n, places in of_length.items():
            codes, h = letters([pieces[i] for i in places], n), np.zeros(len(places), np.uint64)
            for k in range(n):
                h = self.add(h, codes[:, k])
            self.hashes[places] = h
        self.tables, left = [], np.arange(len(pieces))
        while len(left) and len(self.tables) < 3:
            table = np.full(1 << self.BITS, len(pieces), np.int32)
            slot = self.slot(self.hashes[left], len(self.tables))
            table[slot[::-1]] = left[::-1]  # the first to want a slot has it
            self.tables.append(table)
            left = left[table[slot] != left]
        self.last = {int(self.hashes[i]): int(i) for i in left}

    def add(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h + codes + np.uint64(1)) * np.uint64(self.FACTOR)
        return h ^ (h >> np.uint64(29))

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.BITS - 15 * k)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        for k, table in enumerate(self.tables):
            i = table[self.slot(h, k)]
            np.copyto(out, i, where=self.hashes[i] == h, casting="unsafe")
        if self.last:
            for at in np.flatnonzero(out < 0).tolist():
                out[at] = self.last.get(int(h[at]), -1)
        return out


def long_lattice(word: str, table: PieceTable, most: int = 1 << 12) -> Iterator[np.ndarray]:
    """For a word of any length, in blocks: a row for each letter, the piece of each length that ends there, or -1."""
    codes = letters([word], len(word))[0]
    for begin in range(0, len(word), most):
        n = min(most, len(word) - begin)
        ahead = min(begin, table.longest - 1)
        some = codes[begin - ahead : begin + n]
        out, h = np.full((n, table.longest), -1, np.int64), np.zeros(len(some), np.uint64)
        for size in range(1, min(table.longest, len(some)) + 1):
            h = table.add(h[: len(some) - size + 1], some[size - 1 :])
            pieces = table.find(h)
            ends = np.arange(len(h)) + size - 1 - ahead
            out[ends[ends >= 0], size - 1] = pieces[ends >= 0]
        yield out


def letters(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)


def lattices(words: list[str], table: PieceTable, most: int = 1 << 14) -> Iterator[tuple[list[int], list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Words of one length at a time: (their places in `words`, [(begin, end, which of them have a piece there, that piece)]),
    ends rising."""
    of_length: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        of_length[len(w)].append(k)
    for n, places in of_length.items():
        for i in range(0, len(places), most):
            some = places[i : i + most]
            codes, spans = letters([words[k] for k in some], n), []
            for begin in range(n):
                h = np.zeros(len(some), np.uint64)
                for end in range(begin + 1, min(n, begin + table.longest) + 1):
                    h = table.add(h, codes[:, end - 1])
                    pieces = table.find(h)
                    has = np.flatnonzero(pieces >= 0)
                    if 6 * len(has) > len(some):
                        spans.append((begin, end, slice(None), pieces))  # no piece: the row of zeros at the end
                    elif len(has):
                        spans.append((begin, end, has, pieces[has]))
            yield some, sorted(spans, key=lambda x: x[:2][::-1])


class Model:
    """table: a row for each piece, a column for each language. floor: the probability of a letter that is no piece."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray, floor: float):
        self.langs, self.pieces, self.table, self.floor = langs, pieces, table, floor
        self.index = {p: i for i, p in enumerate(pieces)}
        self.find = PieceTable(pieces)
        self.rows = np.concatenate([table, np.zeros((1, len(langs)))])
        self.slots: dict[str, int] = {}
        self.held = 0  # letters of these words
        self.scores = np.zeros((0, len(langs)))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word in each language, over all segmentations, by the forward algorithm."""
        out = np.zeros((len(words), len(self.langs)))
        marked = ["▁" + w for w in words]
        short = [k for k, w in enumerate(marked) if len(w) <= SHORT]
        for places, spans in lattices([marked[k] for k in short], self.find):
            n = len(marked[short[places[0]]])
            forward = np.zeros((n + 1, len(places), len(self.langs)))
            forward[0] = 1
            single = np.ones((n + 1, len(places)), bool)
            for begin, end, has, pieces in spans:
                if end - begin == 1:
                    single[end][has] = pieces < 0
            at = 0
            for end in range(1, n + 1):
                forward[end][single[end]] = forward[end - 1][single[end]] * self.floor * SCALE
                while at < len(spans) and spans[at][1] == end:
                    begin, _, has, pieces = spans[at]
                    forward[end][has] += forward[begin][has] * self.rows[pieces] * SCALE ** (end - begin)
                    at += 1
            out[[short[k] for k in places]] = np.log(np.maximum(forward[n], 5e-324)) - n * math.log(SCALE)
        for k, w in enumerate(marked):
            if len(w) > SHORT:
                out[k] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same for a word of any length: only the last sums are held, and divided by the latest now and then."""
        most, langs = self.find.longest, len(self.langs)
        forward, logs = np.zeros((most, langs)), np.zeros(langs)  # the sums up to the last letters, the latest last
        forward[-1] = 1
        for pieces in long_lattice(word, self.find):
            for found in pieces:
                at = np.flatnonzero(found >= 0)
                x = (forward[most - 1 - at] * self.rows[found[at]] * SCALE ** (at + 1)[:, None]).sum(0)
                if found[0] < 0:
                    x += forward[-1] * self.floor * SCALE
                forward[:-1] = forward[1:]
                forward[-1] = x
                if x.min() < 1e-100 or x.max() > 1e100:
                    logs += np.log(np.maximum(x, 5e-324))
                    forward /= np.maximum(x, 5e-324)
        return logs + np.log(np.maximum(forward[-1], 5e-324)) - len(word) * math.log(SCALE)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.slots]
        size = sum(map(len, new))
        if len(self.slots) + len(new) > MOST_WORDS or self.held + size > MOST_LETTERS:
            self.slots, new, self.held = {}, list(words), 0
            self.scores = self.scores[:0]
            size = sum(map(len, new))
        self.held += size
        if new:
            begin = len(self.slots)
            if begin + len(new) > len(self.scores):
                grown = np.zeros((2 * begin + len(new), len(self.langs)))
                grown[:begin] = self.scores[:begin]
                self.scores = grown
            self.scores[begin : begin + len(new)] = self.log_probabilities(new)
            self.slots.update(zip(new, range(begin, begin + len(new))))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        cut = [*map(words_of, texts)]
        self.learn(set(chain.from_iterable(cut)))
        out = []
        for words in cut:
            if not words:
                out.append(("und", 0.0))
                continue
            x = self.scores[np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))].sum(0)
            p = np.exp(x - x.max())
            k = int(p.argmax())  # ties to the first language by code point
            out.append((self.langs[k], float(p[k] / p.sum())))
        return out


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: of the training words of each language. Each round takes expected piece counts over all segmentations
    (forward-backward) and divides."""
    langs = sorted(counts)
    single = sorted({"▁"}.union(c for words in counts.values() for w in words for c in w))
    pieces = list(dict.fromkeys([*pieces, *single]))  # single letters make every word reachable
    find = PieceTable(pieces)
    table = np.zeros((len(pieces), len(langs)))
    for k, lang in enumerate(langs):
        words, long = [w for w in counts[lang] if len(w) < SHORT], [w for w in counts[lang] if len(w) >= SHORT]
        weights = np.array([counts[lang][w] for w in words], float)
        groups = [(weights[at], spans) for at, spans in lattices(["▁" + w for w in words], find)]
        p = np.full(len(pieces), 1 / len(pieces))
        for _ in range(rounds):
            expected, q = np.zeros(len(pieces) + 1), np.append(p, 0.0)
            for weight, spans in groups:
                _expect(weight, spans, q, expected)
            for w in long:
                _expect_long(counts[lang][w], "▁" + w, find, q, expected)
            p = (expected[:-1] + 0.1) / (expected[:-1].sum() + 0.1 * len(pieces))
        table[:, k] = p
    return Model(langs, pieces, table, float(table.min()) if langs else 1e-9)


def _expect(weight: np.ndarray, spans: list[tuple[int, int, np.ndarray, np.ndarray]], p: np.ndarray, expected: np.ndarray) -> None:
    n = spans[-1][1]
    forward, backward = np.zeros((n + 1, len(weight))), np.zeros((n + 1, len(weight)))
    forward[0] = backward[n] = 1
    for begin, end, has, pieces in spans:
        forward[end][has] += forward[begin][has] * p[pieces] * SCALE ** (end - begin)
    for begin, end, has, pieces in reversed(spans):
        backward[begin][has] += backward[end][has] * p[pieces] * SCALE ** (end - begin)
    share = weight / np.maximum(forward[n], 1e-300)
    for begin, end, has, pieces in spans:
        np.add.at(expected, pieces, (share * forward[begin] * backward[end])[has] * p[pieces] * SCALE ** (end - begin))


def _expect_long(weight: float, word: str, table: PieceTable, p: np.ndarray, expected: np.ndarray, block: int = 1 << 12) -> None:
    """The same for a long word: sums of either direction are divided at each letter, and blocks of the word overlap by eight
    of the longest pieces on either side, beyond which where the sums start no longer counts."""
    ahead = 8 * table.longest
    for begin in range(0, len(word), block):
        first, last = max(0, begin - ahead), min(len(word), begin + block + ahead)
        found = np.concatenate([*long_lattice(word[first:last], table)])
        n = last - first
        weights = p[found] * (found >= 0)  # of the pieces that end at each letter, by length
        forward, by = np.zeros(n + 1), np.ones(n + 1)  # forward[i] times the product of by[: i + 1] is the sum
        forward[0] = 1
        for end in range(1, n + 1):
            m = min(end, table.longest)
            x = 0.0
            scale = 1.0
            for size in range(1, m + 1):
                x += forward[end - size] * scale * weights[end - 1, size - 1]
                scale /= by[end - size]
            by[end] = x
            forward[end] = 1.0
        backward = np.zeros(n + 1)
        backward[n] = 1.0
        for start in range(n - 1, -1, -1):
            x, scale = 0.0, 1.0
            for size in range(1, min(n - start, table.longest) + 1):
                scale /= by[start + size]
                x += backward[start + size] * scale * weights[start + size - 1, size - 1]
            backward[start] = x
        for size in range(1, table.longest + 1):
            ends = np.arange(max(size, begin - first + 1), min(n, begin - first + block) + 1)
            scale = np.ones(len(ends))
            for k in range(size):
                scale /= by[ends - k]
            np.add.at(expected, found[ends - 1, size - 1], weight * backward[ends] * scale * weights[ends - 1, size - 1])


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str, per_lang: int = 300, most_langs: int = MOST_LANGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a language whose id isn't held out."""
    text = docs[text_col].cast("string")
    rows = docs.where(~is_held_out(docs[id_col])).select(docs[lang_col].cast("string").alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    shares = written(most.select("lang", (F.lit(float(per_lang)) / F.col("n")).alias("share")), "languages")  # most_langs rows at most
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(shares), "lang").where(mark < F.col("share"))
    chosen = chosen.groupBy("lang", digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts = Counter((lang, word) for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)) for word in words_of(text))
            langs, words = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    found = on_batches(chosen.select("lang", "text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in found.toLocalIterator():  # words of a bounded sample
        counts[r["lang"]][r["word"]] = r["n"]
    return fit(counts, pieces_of(path))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the id only says whether a row was held out."""
    share = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.langs, model.pieces, model.table, model.floor))  # a row for each piece of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _local(share)
        for batch in small_batches(batches):
            out = own.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return on_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


_LAST: tuple[str, Model] | None = None


def _local(share) -> Model:
    """The worker's copy of a model, with the words it has scored; that of another model replaces it."""
    global _LAST
    name, *parts = share.value
    if _LAST is None or _LAST[0] != name:
        _LAST = name, Model(*parts)
    return _LAST[1]
