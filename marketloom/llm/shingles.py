"""Word shingles of many texts at once, as 64-bit numbers in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from marketloom.llm.common import BLANKS

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at a time; a step holds about 40 bytes for each.
PIECE = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def word_hashes(raws: list[bytes], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, in order. A word's hash is its bytes' polynomial, so a word that is cut by the end of a
    piece is put together from both parts."""
    ups, downs = _powers(_P, piece), _powers(_P_INVERSE, piece + 1)
    begins, sizes, sums, at = [], [], [], 0
    open_word = False  # whether the last word so far may go on
    for part in _pieces(raws, piece):
        data = np.frombuffer(part, np.uint8)
        blank = np.concatenate([[True], _BLANK[data], [True]])
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        with np.errstate(over="ignore"):
            running = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[: len(data)])])
            h = (running[last] - running[first]) * downs[first]
        size = last - first
        if open_word and len(first) and first[0] == 0:
            most = 1 << 64
            sums[-1][-1] = (int(sums[-1][-1]) + int(h[0]) * pow(_P, int(sizes[-1][-1]), most)) % most
            sizes[-1][-1] += size[0]
            first, size, h = first[1:], size[1:], h[1:]
        if len(first):
            begins.append(first + at)
            sizes.append(size)
            sums.append(h)
        open_word = len(data) > 0 and not blank[-2]
        at += len(part)
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stops = np.cumsum([len(r) + 1 for r in raws])
    with np.errstate(over="ignore"):
        return np.searchsorted(stops, np.concatenate(begins), "right"), mix(np.concatenate(sums) + np.concatenate(sizes).astype(np.uint64) * _STEP)


def _pieces(raws: list[bytes], piece: int) -> Iterator[bytes]:
    """The texts, a blank after each, in pieces of that many bytes at most."""
    held: list[bytes] = []
    size = 0
    for raw in raws:
        if size + len(raw) + 1 > piece and held:
            yield b"".join(held)
            held, size = [], 0
        if len(raw) + 1 <= piece:
            held += [raw, b" "]
            size += len(raw) + 1
        else:
            yield from (raw[i : i + piece] for i in range(0, len(raw), piece))
            yield b" "
    if held:
        yield b"".join(held)


def shingle_cells(raws: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell), sorted by text. A shingle that a text has n times gives it n cells, the same n in any text.

    A text of fewer than `size` words has one shingle, of all its words; a text without words has none. So the Jaccard
    index of cells is the weighted Jaccard index of shingles by count."""
    doc, h = word_hashes(raws)
    counts = np.bincount(doc, minlength=len(raws))
    first = np.cumsum(counts) - counts
    width = np.minimum(counts, size)[doc]  # words in this text's shingles
    at = np.flatnonzero(np.arange(len(doc)) + width <= (first + counts)[doc])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        go = width[at] > k
        out[go] = mix(out[go] + h[at[go] + k] + np.uint64(k + 1))
    doc = doc[at]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])])[: len(out)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
    with np.errstate(over="ignore"):
        return doc, mix(out + (np.arange(len(out)) - start).astype(np.uint64) * _STEP)
