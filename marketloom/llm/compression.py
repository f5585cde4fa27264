"""Quality rules by compression bands, after a base of plain counts.

zstandard ratios (bytes in / bytes out) of the whole text and of fixed chunks. Prose of one length compresses within a
narrow band: text above it repeats itself, text below it is noise. Bands depend on length, since a short text has
nothing to refer back to. A text is kept if the base keeps it, its ratio is within the band of its length, and at most
CHUNK_SHARE of its bytes lie in chunks outside the chunk band; what is left after full chunks has the band of its length.

BANDS and CHUNK_BAND were read off invented prose; fit_bands() reads them off texts that are known to be good.

Null text counts as empty. Every row gives one row, whatever repeats; other columns are left out. Very long texts are
compressed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import BLANKS, on_batches, small_batches, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Band(NamedTuple):
    """Ratios that a text of up to most_bytes may have."""

    most_bytes: float
    least: float
    most: float


#: Lower limits lie under the least of 3409 labelled good texts of each length (zstandard level 3) and, where there is room
#: between, over noise (words of random letters, base64, hexadecimal and decimal digits); upper ones are prose's, widened.
BANDS = (
    Band(128, 0.8, 1.6), Band(256, 1.05, 1.85), Band(512, 1.28, 2.05), Band(1024, 1.4, 2.15), Band(2048, 1.7, 2.22),
    Band(4096, 1.9, 2.33), Band(8192, 2.11, 2.43), Band(16384, 2.19, 2.52), Band(65536, 2.25, 2.66), Band(float("inf"), 2.25, 3.0),
)
CHUNK_BYTES = 4096
CHUNK_BAND = Band(CHUNK_BYTES, 1.95, 2.36)
CHUNK_SHARE = 0.5


def repeated_words(words: Sequence[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Of texts given as arrays of word numbers: how many words lie in windows that their text has twice or more.

    window: a power of two. Windows are named by doubling: a window of 2w words is the pair of names of its halves,
    numbered anew, so equal names mean equal words. What isn't repeated at w words is left out at 2w."""
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    out = np.zeros(len(words), np.int64)
    if total < window:
        return out
    doc = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # words from here to the text's end
    plain = np.concatenate(words)
    at, key, span = np.arange(total), doc * (int(plain.max()) + 1) + plain, 1
    while True:
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[name] > 1
        at, name = at[often], name[often]
        if span == window or not len(at):
            break
        names = np.full(total, -1, np.int64)
        names[at] = name
        at = at[left[at] >= 2 * span]
        at = at[names[at + span] >= 0]
        key = names[at] * total + names[at + span]
        span *= 2
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + span, -1)
    np.add.at(out, doc[np.cumsum(cover[:-1]) > 0], 1)
    return out


def ratio(packer: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(data) / len(packer.compress(data)) if data else 0.0


def in_band(x: float, n: int, bands: Sequence[Band]) -> bool:
    band = next(b for b in bands if n <= b.most_bytes)
    return band.least <= x <= band.most


def fit_bands(good: DataFrame, lengths: Sequence[float] = tuple(b.most_bytes for b in BANDS), outside: float = 0.002, room: float = 0.03, id_col: str = "doc_id", text_col: str = "text") -> list[Band]:
    """Bands from good texts: of each length the ratios that all but a share `outside` have on either side, wider by `room`
    of them. Lengths that no text has get the band of the next shorter one that some have, or are open."""
    cut = F.lit(None).cast("int")
    for k, most in reversed([*enumerate(lengths)]):
        cut = F.when(F.col("n_bytes") <= F.lit(float(most)), k).otherwise(cut)
    edges = F.percentile_approx("ratio", [outside, 1 - outside], 10_000)
    rows = judge(good, id_col=id_col, text_col=text_col).where("n_bytes > 0").groupBy(cut.alias("band")).agg(edges.alias("edges")).collect()  # a row for each length
    found = {r["band"]: (r["edges"][0] * (1 - room), r["edges"][1] * (1 + room)) for r in rows}
    out, last = [], (0.0, float("inf"))
    for k, most in enumerate(lengths):
        last = found.get(k, last)
        out.append(Band(float(most), *last))
    return out


def judge(docs: DataFrame, bands: Sequence[Band] = BANDS, chunk_band: Band = CHUNK_BAND, chunk_share: float = CHUNK_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, ratios and the verdict for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        for batch in small_batches(batches):
            texts, number = texts_of(batch), defaultdict(count().__next__)
            raws = [x.encode("utf-8", "surrogatepass") for x in texts]
            words = [np.fromiter(map(number.__getitem__, r.split()), np.int64) for r in raws]
            repeats = repeated_words(words).tolist()
            rows = []
            for text, raw, ws, n_repeat in zip(texts, raws, words, repeats):
                lines = [x for x in raw.split(b"\n") if x.strip()]
                whole = ratio(packer, raw)
                odd = sum(len(c) for i in range(0, len(raw), CHUNK_BYTES) if not in_band(ratio(packer, c := raw[i : i + CHUNK_BYTES]), len(c), [chunk_band] if len(c) == CHUNK_BYTES else bands))
                failed = len(ws) < 20 or 100 * n_repeat > 30 * len(ws)
                kept = not failed and in_band(whole, len(raw), bands) and odd <= chunk_share * len(raw)
                rows.append((len(ws), len(text) - sum(map(text.count, BLANKS.decode())), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed, whole, odd / max(1, len(raw)), kept, len(raw)))
            cols = list(zip(*rows))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=NAMES)

    return on_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, SCHEMA)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_share double, kept boolean, n_bytes long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
