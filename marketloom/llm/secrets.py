"""Secret scan with a recursive decoding worklist.

Each text is a layer. A layer is scanned for the base kinds, then unwrapped: percent escapes and character escapes give
the same layer with the escapes resolved; each base64 run gives layers of its own, and what turns out to be gzip, zlib,
bzip2 or zstandard in it is unpacked. Every layer is scanned, also one that isn't valid text. New layers join the worklist
until it is empty; a layer that is met again inside itself ends a cycle, and one that is met again elsewhere isn't searched
twice, but what it holds is reported at every place. Every letter of a layer knows the span of the original text that it came
from, and what is found is reported there, as `assign`, `access` or `hex` after the path of decoders, for example
`base64.gzip.assign`. Spans that the text shows plainly are the base; decoding only adds to them, and a kind is reported once
for a span.

Unpacked data is read as a stream, member after member, in pieces of about PIECE bytes, which end where no kind or escape
goes on; each piece is a layer. Where MOST_PIECE bytes have no such place, pieces overlap by OVERLAP. All of a piece stands
for one span of the original, so it doesn't matter in which piece something is found.

Offsets are code points, end exclusive. Null text has no findings. Rows repeat as in the input, other columns are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from marketloom.llm.common import on_batches, small_batches, texts_of

# Fixed patterns and least lengths of the base kinds.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so short ones may be passed over while matching
LEAST_VALUE, LEAST_ACCESS = 12, 18
_WORDS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u\{([0-9A-Fa-f]{1,6})\}|[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: A maximal run over both alphabets, joined over single line breaks.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=(?:[A-Za-z0-9+/_-]|\r?\n(?=[A-Za-z0-9+/_-])){16})[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)*+(?:(?:\r?\n)?=){0,2}")
LEAST_RUN = 16
_BREAK = re.compile(r"\r?\n")
_STARTS = re.compile(r"[+/_-]+|\r?\n")
#: How base64 of gzip, zlib, bzip2 and zstandard data begins.
_MAGIC = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|KLUv/")
PIECE, MOST_PIECE, OVERLAP, STEP = 1 << 22, 1 << 24, 1 << 20, 1 << 16
#: Bytes that are in no kind, base64 run or escape: a piece may end after one.
_BETWEEN = [bytes([c]) for c in b",()[]<>!?*|~`@$^"]
_ERRORS = (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError)


class Places:
    """Where the letters of a layer come from in the original, as runs: letters that were copied one after the other, or one
    letter that stands for the span of an escape (`end` is -1 for the first sort)."""

    def __init__(self) -> None:
        self.at, self.begin, self.end = array("q"), array("q"), array("q")

    def add(self, at: int, begin: int, end: int = -1) -> None:
        self.at.append(at)
        self.begin.append(begin)
        self.end.append(end)

    def copy(self, other: Places | None, a: int, b: int, at: int) -> None:
        """Letters a to b of the layer that `other` belongs to (None: the original) go to `at`."""
        if other is None:
            if b > a:
                self.add(at, a)
            return
        i = bisect.bisect(other.at, a) - 1
        while i < len(other.at) and other.at[i] < b:
            x = max(other.at[i], a)
            if other.end[i] < 0:
                self.add(at + x - a, other.begin[i] + x - other.at[i])
            elif x == other.at[i]:
                self.add(at + x - a, other.begin[i], other.end[i])
            i += 1

    def span(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect.bisect(self.at, a) - 1, bisect.bisect(self.at, b - 1) - 1
        begin = self.begin[i] + (a - self.at[i] if self.end[i] < 0 else 0)
        return begin, self.begin[j] + b - self.at[j] if self.end[j] < 0 else self.end[j]


class Layer(NamedTuple):
    """text, where its letters come from in the original (None: as they are; a pair: all from one span), and the decoders so
    far."""

    text: str
    places: Places | tuple[int, int] | None
    path: tuple[str, ...]

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.places, tuple):
            return self.places
        return (a, b) if self.places is None else self.places.span(a, b)


class Packed(NamedTuple):
    """Compressed data, which can be read again and again, with its span and the decoders before it. above: digests of the
    first piece of each stream that it was unpacked from."""

    stream: Callable[[], Iterator[bytes]]
    begin: int
    end: int
    path: tuple[str, ...]
    above: frozenset[bytes] = frozenset()
    ended: list[int] | None = None  # given the count of its bytes once they are unpacked


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, without those that are too short."""
    found = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _resolved(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer:
    """The layer with each match replaced by decode(match), a list of (letter, begin, end)."""
    text, at, path = layer.text, 0, (*layer.path, name)
    if isinstance(layer.places, tuple):
        return Layer(pattern.sub(lambda m: "".join(x[0] for x in decode(m)), text), layer.places, path)
    out, size, places = [], 0, Places()
    for m in pattern.finditer(text):
        places.copy(layer.places, at, m.start(), size)
        out.append(text[at : m.start()])
        size += m.start() - at
        for letter, a, b in decode(m):
            out.append(letter)
            places.add(size, *layer.span(a, b))
            size += 1
        at = m.end()
    places.copy(layer.places, at, len(text), size)
    out.append(text[at:])
    return Layer("".join(out), places, path)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    raw, at, out = bytes.fromhex(m[0].replace("%", "")), m.start(), []
    try:
        letters = raw.decode("utf-8")
    except UnicodeDecodeError:
        letters = None
    for c in letters if letters is not None else raw.decode("latin-1"):
        n = 3 * (len(c.encode("utf-8")) if letters is not None else 1)
        out.append((c, at, at + n))
        at += n
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    if m.lastindex is None:
        high, low = int(m[0][2:6], 16), int(m[0][8:12], 16)
        code = 0x10000 + (high - 0xD800 << 10) + (low - 0xDC00)
    else:
        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return [(c, i, i + 1) for i, c in enumerate(m[0], m.start())]
    return [(chr(code), *m.span())]


def _format(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if data[:3] == b"BZh" else "zstd" if data[:4] == b"\x28\xb5\x2f\xfd" else None


class _Source:
    """Reads chunks in steps. taken: bytes read so far, without those put back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.taken, self.failed = chunks, b"", 0, False

    def head(self) -> bytes:
        while len(self.held) < 4 and (more := next(self.chunks, b"")):
            self.held += more
        return self.held[:4]

    def read(self, most: int) -> bytes:
        self.head()
        out, self.held = self.held[:most], self.held[most:]
        self.taken += len(out)
        return out

    def put_back(self, data: bytes) -> None:
        self.held, self.taken = data + self.held, self.taken - len(data)


def _members(name: str, source: _Source) -> Iterator[bytes]:
    """What the next members of a format hold, in steps; of a damaged one, as much as comes out."""
    # a few bytes of zstandard may make 128 kB, and its reader can't be stopped between
    step = 256 if name == "zstd" else STEP
    try:
        while _format(source.head()) == name:
            if name == "zstd":
                reader = zstandard.ZstdDecompressor().decompressobj()
            else:
                reader = bz2.BZ2Decompressor() if name == "bzip2" else zlib.decompressobj(31 if name == "gzip" else 15)
            data = source.read(step)
            while True:
                out = reader.decompress(data) if name == "zstd" else reader.decompress(data, STEP)
                if out:
                    yield out
                if reader.eof:
                    break
                data = b"" if name == "zstd" else getattr(reader, "unconsumed_tail", b"")
                if not data and (name == "zstd" or len(out) < STEP):
                    data = source.read(step)
                    if not data:
                        return
            source.put_back(reader.unused_data)
            while name == "gzip" and source.head()[:1] == b"\0":  # padding between members
                source.put_back(source.read(STEP).lstrip(b"\0"))
    except _ERRORS:
        source.failed = True


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held, limit = bytearray(), PIECE
    for chunk in chunks:
        held += chunk
        if len(held) < limit:
            continue
        cut = max(map(held.rfind, _BETWEEN)) + 1
        if cut:
            yield bytes(held[:cut])
            del held[:cut]
            limit = len(held) + PIECE
        elif len(held) < MOST_PIECE:
            limit = min(2 * limit, MOST_PIECE)
        else:
            yield bytes(held)
            del held[: len(held) - OVERLAP]
            limit = MOST_PIECE
    if held:
        yield bytes(held)


def _unpacked(packed: Packed) -> Iterator[Layer | Packed]:
    """The layers of packed data, and what is packed in it again."""
    source, part = _Source(packed.stream()), 0
    while name := _format(source.head()):
        path, pieces = (*packed.path, name), _pieces(_members(name, source))
        first, second = next(pieces, b""), next(pieces, b"")
        mark = hashlib.blake2b(first, digest_size=16).digest()
        if _format(first) and mark not in packed.above:
            stream = (lambda part=part: _part(packed.stream, part)) if second else (lambda first=first: iter([first]))
            yield Packed(stream, packed.begin, packed.end, path, packed.above | {mark})
        for piece in chain((first, second), pieces):
            for text in _texts(piece) if piece else ():
                yield Layer(text, (packed.begin, packed.end), path)
        if source.failed:
            return
        part += 1
    if packed.ended is not None:
        packed.ended.append(source.taken)


def _part(stream: Callable[[], Iterator[bytes]], part: int) -> Iterator[bytes]:
    """Unpacks a stream anew, as it is too large to be held: what its part of that number holds."""
    source = _Source(stream())
    for k in range(part + 1):
        for chunk in _members(_format(source.head()) or "", source):
            if k == part:
                yield chunk


def _texts(data: bytes) -> Iterator[str]:
    """Decoded data as text, whatever it is: as UTF-8, or else byte by byte; with zero bytes, as UTF-16 of either order and
    with those bytes left out, too. The base kinds and all escapes are ASCII, so what stands for other letters hides none."""
    try:
        yield data.decode("utf-8")
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    if b"\0" in data:
        for order in ("<u2", ">u2"):
            units = np.frombuffer(data, order, len(data) // 2)
            yield np.where(units < 128, units, 255).astype(np.uint8).tobytes().decode("latin-1")
        yield data.replace(b"\0", b"").decode("latin-1")


def _decoded(run: str) -> bytes:
    """As much of a run as makes whole bytes."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _base64_layers(layer: Layer) -> Iterator[Layer | Packed]:
    """Of each run: what it decodes to from its start, and from wherever letters may have been put before it that aren't its
    own (at a line break or a sign of either alphabet), once for each of the four phases; and what is packed in it."""
    for m in _BASE64.finditer(layer.text):
        body = m[0].rstrip("=\r\n")
        run = _BREAK.sub("", body).replace("-", "+").replace("_", "/")
        if len(run) < LEAST_RUN:
            continue
        # starts in the text, and how many letters of the run lie before them
        starts, gone = [(0, 0)], 0
        for b in _STARTS.finditer(body):
            gone += len(b[0]) if b[0][-1] == "\n" else 0
            starts.append((b.end(), b.end() - gone))
        b = layer.span(m.start(), m.end())[1]
        path = (*layer.path, "base64")
        magic = _MAGIC.search(run)
        places = [(k, at) for at, k in starts] if magic else []
        while magic:
            k = magic.start()
            first, at = places[bisect.bisect(places, (k, len(body))) - 1]
            a = layer.span(m.start() + at + k - first, m.end())[0]
            stream = lambda k=k: (_decoded(run[i : i + STEP]) for i in range(k, len(run), STEP))
            source = _Source(stream())
            name = _format(source.head())
            if name and next(_members(name, source), b""):
                ended: list[int] = []
                yield Packed(stream, a, b, path, ended=ended)
                k += sum(ended) * 4 // 3  # what is packed in these letters isn't looked for in their midst
            magic = _MAGIC.search(run, k + 1)
        phases: set[int] = set()
        for at, k in starts:
            if k % 4 not in phases and len(run) - k >= LEAST_RUN:
                phases.add(k % 4)
                a = layer.span(m.start() + at, m.end())[0]
                for text in _texts(_decoded(run[k:])):
                    yield Layer(text, (a, b), path)


def _inner(layer: Layer) -> Iterator[Layer | Packed]:
    if "%" in layer.text and _PERCENT.search(layer.text):
        yield _resolved(layer, "url", _PERCENT, _percent)
    if ("\\" in layer.text or "&#" in layer.text or "%u" in layer.text) and _ESCAPE.search(layer.text):
        yield _resolved(layer, "unicode", _ESCAPE, _escape)
    yield from _base64_layers(layer)


def _mark(layer: Layer) -> bytes:
    """Equal for layers of equal text whose letters come from the same places, or all from any one span."""
    h = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
    if isinstance(layer.places, Places):
        for x in (layer.places.at, layer.places.begin, layer.places.end):
            h.update(x.tobytes())
    return h.digest()


class _Work:
    """A layer or packed data that is being searched. span: of a layer from one span, which is kept by its mark. found: the
    path of decoders to each kind below it. cut: how deep in the worklist the uppermost layer lies that ended a cycle below."""

    __slots__ = ("span", "mark", "depth", "inner", "found", "cut")

    def __init__(self, span: tuple[int, int] | None, mark: bytes | None, depth: int, inner: Iterator[Layer | Packed]):
        self.span, self.mark, self.depth, self.inner = span, mark, depth, inner
        self.found: dict[str, tuple[str, ...]] = {}
        self.cut = sys.maxsize


_NOTHING: dict[str, tuple[str, ...]] = {}


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by start, then kind, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda x: (x[1], rank[x[0].rpartition(".")[2]], x[2], x[0])
    base = sorted(base_spans(text), key=order)
    known, found = set(base), list(base)

    def report(span: tuple[int, int], kind: str, path: tuple[str, ...]) -> None:
        if (kind, *span) not in known:
            known.add((kind, *span))
            found.append((".".join((*path, kind)), *span))

    def below(top: _Work, span: tuple[int, int], kinds: dict[str, tuple[str, ...]]) -> None:
        for kind, path in kinds.items():
            if top.span is None:
                report(span, kind, path)
            else:
                top.found.setdefault(kind, path)

    whole = Layer(text, None, ())
    # layers are made one by one. Of a layer from one span the kinds below it are held, three at most, by the layer's mark
    held: dict[bytes, dict[str, tuple[str, ...]]] = {}
    seen, above = {_mark(whole)}, {}
    work = [_Work(None, None, 0, _inner(whole))]
    while work:
        top = work[-1]
        layer = next(top.inner, None)
        if layer is None:
            work.pop()
            if top.mark is not None:
                del above[top.mark]
                if top.cut >= len(work):
                    held[top.mark] = {k: p[top.depth :] for k, p in top.found.items()} or _NOTHING
            if work and top.cut < len(work):
                work[-1].cut = min(work[-1].cut, top.cut)
            if top.span is not None:
                below(work[-1], top.span, top.found)
        elif isinstance(layer, Packed):
            work.append(_Work((layer.begin, layer.end), None, 0, _unpacked(layer)))
        elif isinstance(layer.places, tuple):
            mark = _mark(layer)
            if mark in above:
                top.cut = min(top.cut, above[mark])
            elif (kinds := held.get(mark)) is not None:
                below(top, layer.places, {k: layer.path + p for k, p in kinds.items()})
            else:
                above[mark] = len(work)
                work.append(_Work(layer.places, mark, len(layer.path), _inner(layer)))
                for kind, _, _ in base_spans(layer.text):
                    work[-1].found.setdefault(kind, layer.path)
        elif (mark := _mark(layer)) not in seen:
            seen.add(mark)
            for kind, a, b in base_spans(layer.text):
                report(layer.span(a, b), kind, layer.path)
            work.append(_Work(None, None, 0, _inner(layer)))
    return base, sorted(found, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for text in texts_of(batch):
                base, every = scan(text)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows))
            kinds = [*[pa.int64()] * 3, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return on_batches(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
