"""BPE encoding and decoding by a contiguous rank array.

A short word is held as a contiguous array of its parts and, beside it, the rank of each adjacent pair of parts.
The least rank is found by a scan, the boundary inside that pair is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Words of one length stand as rows of one matrix and take these steps
together. The scan is quadratic in the word's length, so words above LONG_WORD bytes take the same merges from a
heap over linked parts.

Texts with characters that are newer than this Python's Unicode tables are normalised and cut by the library's own parts; the
merges are the same. Null text is an empty document, an empty text has no ids, rows that repeat are encoded each, an empty
table gives no rows, and texts of any length are encoded whole. Words repeat a great deal, so each Python worker keeps what it has encoded,
in tables that are emptied when they hold MOST_PIECES words or MOST_LETTERS letters of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketloom.llm.common import on_batches, small_batches, texts_of

LONG_WORD = 64
MOST_PIECES, MOST_LETTERS = 700_000, 24 << 20
#: White space as the vocabulary's own pattern means it (Unicode's White_Space property).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _first_plane(kind: str) -> str:
    """The characters below U+10000 of a general category, as the inside of a class."""
    spans: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] == kind:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


_HIGH = re.compile("[\U00010000-\U0010ffff]").search


#: Marks that the library's tables order otherwise beside other marks; found by the test that goes through all characters.
_ORDERED_OTHERWISE = "\u1df6\U0001e4ec\U0001e4ed"


@lru_cache(maxsize=1)
def _unknown():
    """Finds characters that this Python's Unicode tables don't know, or order otherwise. The library's tables are newer, so it may hold them for letters, digits
    or capitals; whatever both know, both take in the same way (a test goes through all of them)."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1 and c != 0x10000:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    # apart, since a class within the first plane is one table, and one beyond it a list that is gone through for each letter
    low, high = (re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans if (a > 0xFFFF) == beyond) + "".join(c for c in _ORDERED_OTHERWISE if (c > "\uffff") == beyond) + "]").search for beyond in (False, True))
    return lambda text: low(text) or (_HIGH(text) and high(text))


class WordBpe:
    """A word-level BPE vocabulary with end-of-word marks, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.bytes = {x: b for b, x in enumerate(self.letters)}
        self.path = path
        parts = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split_any = regex.compile(parts.replace(r"\s", _SPACE)).findall
        # the same with the letters and numbers of the first plane spelled out, which the standard library matches faster
        plain = parts.replace(r"\s", _SPACE).replace(r"\p{L}", _first_plane("L")).replace(r"\p{N}", _first_plane("N"))
        self.split = re.compile(plain).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.none = len(self.ranks)
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.first = np.array([[self.ids.get(x + end, -1) for x in self.letters] for end in ("", self.suffix)], np.int32)
        self.id_text = {i: f" {i}" for i in self.names}
        self.token_text = {i: f" {t}" for i, t in self.names.items()}
        self.joined: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.held = 0  # letters of these pieces
        self.library = None  # normaliser and pre-tokenizer, once a text needs them

    # -- merges -----------------------------------------------------------------------------------------------

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], self.none)

    def _merge_short(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """parts: the ids of the parts of words of one length, a row for each word. All words step together.

        Returns (rows, their parts) as words come to an end."""
        rows, n, out = np.arange(len(parts)), parts.shape[1], []
        ranks = self._pair_ranks(parts[:, :-1], parts[:, 1:])
        while n > 1 and len(rows):
            k = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), k]
            over = least == self.none
            if over.any():
                out.append((rows[over], parts[over]))
                go = ~over
                rows, parts, ranks, k, least = rows[go], parts[go], ranks[go], k[go], least[go]
            at = np.arange(len(rows))
            parts[at, k] = self.merged[least]
            cols = np.arange(n - 1)
            parts = np.take_along_axis(parts, cols + (cols > k[:, None]), 1)  # the boundary after part k goes
            cols = np.arange(n - 2)
            ranks = np.take_along_axis(ranks, cols + (cols >= k[:, None]), 1)
            n -= 1
            for near in (k, k - 1):
                has = np.flatnonzero((near >= 0) & (near < n - 1))
                ranks[has, near[has]] = self._pair_ranks(parts[has, near[has]], parts[has, near[has] + 1])
        out.append((rows, parts))
        return out

    def _merge_long(self, s: str, bounds: list[int]) -> list[str]:
        """The same merges in the same order, O(n log n)."""
        begins, n = bounds[:-1], len(bounds) - 1
        end = bounds[1:]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := self.ranks.get((s[begins[i] : end[i]], s[begins[j] : end[j]]))) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or end[i] != mid or end[j] != stop:
                continue
            end[i], alive[j], right[i] = stop, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [s[begins[i] : end[i]] for i in range(n) if alive[i]]

    def _found(self, piece: str, ids: Iterable[int]) -> None:
        ids = [i for i in ids if i >= 0]
        self.joined[piece] = "".join(map(self.id_text.__getitem__, ids))
        self.back[piece] = "".join(map(self.token_text.__getitem__, ids))

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet."""
        new = pieces - self.joined.keys()
        size = sum(map(len, new))
        if len(self.joined) + len(new) > MOST_PIECES or self.held + size > MOST_LETTERS:
            self.joined.clear()
            self.back.clear()
            new, self.held = pieces, 0
            size = sum(map(len, new))
        self.held += size
        of_length: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for piece in new:
            raw = piece.encode("utf-8", "surrogatepass")
            if piece in self.special:
                self._found(piece, [self.special[piece]])
            elif len(raw) <= LONG_WORD:
                of_length[len(raw)].append((piece, raw))
            else:
                s = "".join(self.letters[b] for b in raw)
                self._found(piece, [self.ids.get(p, -1) for p in self._merge_long(s + self.suffix, [*range(len(s)), len(s) + len(self.suffix)])])
        for n, group in of_length.items():
            for i in range(0, len(group), 1 << 14):
                some = group[i : i + (1 << 14)]
                raw = np.frombuffer(b"".join([x for _, x in some]), np.uint8).reshape(-1, n)
                parts = np.concatenate([self.first[0][raw[:, :-1]], self.first[1][raw[:, -1:]]], axis=1)
                for rows, ids in self._merge_short(parts):
                    for r, x in zip(rows.tolist(), ids.tolist()):
                        self._found(some[r][0], x)

    # -- texts ------------------------------------------------------------------------------------------------

    def _by_library(self, text: str) -> list[str]:
        """The pieces as the file's own normaliser and pre-tokenizer give them."""
        if self.library is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.path)
            self.library = (whole.normalizer, whole.pre_tokenizer)
        normalizer, cutter = self.library
        pieces = cutter.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _unknown()(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text)
        # letter by letter: the vocabulary's lower case knows no final sigma
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return self.split_any(text) if _HIGH(text) else self.split(text)

    def cut_up(self, text: str) -> list[str]:
        """The pieces of a text that the merges see, and special tokens as they are."""
        if self.cut and any(t in text for t in self.special):
            return [q for p in self.cut(text) for q in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, the ids in decimal joined by a space, and what they decode to.

        The file names no decoder, so decoding joins tokens by a space."""
        cut = [*map(self.cut_up, texts)]
        self.learn(set(chain.from_iterable(cut)))
        for pieces in cut:
            ids = "".join(map(self.joined.__getitem__, pieces))
            yield ids.count(" "), ids[1:], "".join(map(self.back.__getitem__, pieces))[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.round_trips([text]))[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.token_text[i] for i in ids if i in self.names)[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 and, if asked for, decoded of each row; rows repeat as they do in docs, other
    columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in small_batches(batches):
            out = [*bpe.round_trips(texts_of(batch))]
            n = np.array([x[0] for x in out], np.int64)
            ids = np.array(" ".join([x[1] for x in out if x[0]]).split(), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
            cols = [batch.column("doc_id"), pa.array(n), lists, pa.array([_sha(x[2]) for x in out], pa.string())]
            if decoded:
                cols.append(pa.array([x[2] for x in out], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded_sha256", "decoded"][: len(cols)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return on_batches(rows, run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string" + ", decoded string" * decoded)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 of the joined ids and of the decoded text in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in small_batches(batches):
            n, ids, decoded = [], [], []
            for count, joined, back in bpe.round_trips(texts_of(batch)):
                n.append(count)
                ids.append(_sha(joined))
                decoded.append(_sha(back))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return on_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
