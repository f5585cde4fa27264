"""Token ids in sorted-string-table shards.

Documents are dealt by ranges of their key and each range becomes one file:

    block*  bloom  index  footer

A block holds entries in key order: varint shared (bytes of the key it shares with the one before), varint unshared,
varint n (tokens), the unshared bytes, n ids of `width` bytes, little-endian. Every RESTART entries the key is whole.
Blocks are zstandard frames. The index has, for each block, its last key, offset, size and CRC-32; the Bloom filter
covers the integer part of all keys; the footer has the places of both, counts and a magic. A lookup asks the filter,
bisects the index and reads one block.

A key is 1 byte (0 for a null id, 1 else), the id as 8 bytes that sort as the integer does, and 8 bytes of the text's
hash and a running number that keep rows apart that share an id; null ids come first. Null text is an empty document.
Rows that repeat are kept, next to each other. Extra columns are left out. Texts of any length are encoded whole; an empty table
gives no shards and no rows.

A shard is written under a temporary name and moved, so a task that is run again replaces what it wrote.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import new_path, on_batches, small_batches, written

MAGIC = b"LOOMSST1"
FOOTER = struct.Struct("<QQQQQQBB8s")
BLOCK_BYTES, RESTART = 1 << 16, 16
BLOOM_BITS, BLOOM_PROBES = 10, 7
MOST_WORDS, MOST_LETTERS = 1_200_000, 32 << 20
#: Words that go to the library as one text; what may part them, and what its neighbours are tried with.
GROUP, MARKS, PROBES = 128, "\x01\x02\x1f|", ("", "a", "Zé1", "'s", "...", "\u0301x", "\x01")
#: Text that a shard is meant for.
SHARD_BYTES = 64 << 20


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# -- the format ---------------------------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def make_key(doc_id: int | None, text_hash: int, number: int) -> bytes:
    return struct.pack(">BQQI", doc_id is not None, (doc_id or 0) + (1 << 63), text_hash & (1 << 64) - 1, number)


def key_id(key: bytes) -> int | None:
    some, doc_id = struct.unpack_from(">BQ", key)
    return doc_id - (1 << 63) if some else None


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _probes(ids: np.ndarray, bits: int) -> np.ndarray:
    h = _mixed(ids)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(BLOOM_PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.tokens = 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.ids: list[int] = []
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: of self.width bytes each."""
        shared = 0 if self.entries % RESTART == 0 else len(os.path.commonprefix([key, self.last]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(ids) // self.width) + key[shared:] + ids
        self.entries, self.last = self.entries + 1, key
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids) // self.width
        if (doc_id := key_id(key)) is not None:
            self.ids.append(doc_id)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def _end_block(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.last, *self._put(data), zlib.crc32(data)))
            self.block, self.entries, self.last = bytearray(), 0, b""

    def close(self) -> None:
        self._end_block()
        bits = max(64, BLOOM_BITS * len(self.ids))
        field = np.zeros((bits + 7) // 8, np.uint8)
        if self.ids:
            at = _probes(np.array(self.ids, np.int64), bits).ravel()
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        bloom = self._put(struct.pack("<Q", bits) + field.tobytes())
        index = self._put(b"".join(varint(len(k)) + k + varint(a) + varint(n) + struct.pack("<I", c) for k, a, n, c in self.index))
        self.out.write(FOOTER.pack(*bloom, *index, self.docs, self.tokens, self.width, 1, MAGIC))


class Reader:
    def __init__(self, source):
        """source: a random-access file."""
        self.source = source
        size = source.size()
        *places, self.docs, self.tokens, self.width, _, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bloom = places[:2]
        data, at, self.index = source.read_at(places[3], places[2]), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            begin, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, begin, length, struct.unpack_from("<I", data, at)[0]))
            at += 4
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, begin, length, crc = self.index[k]
        data = self.source.read_at(length, begin)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unzip.decompress(data), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n * self.width]
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_have(self, doc_id: int) -> bool:
        data = self.source.read_at(self.bloom[1], self.bloom[0])
        bits = struct.unpack_from("<Q", data)[0]
        return all(data[8 + (at >> 3)] >> (at & 7) & 1 for at in map(int, _probes(np.array([doc_id]), bits)[0]))

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each row with this id."""
        out: list[np.ndarray] = []
        if self.may_have(doc_id):
            first = make_key(doc_id, 0, 0)
            for k in range(bisect.bisect_left([x[0] for x in self.index], first), len(self.index)):
                for key, ids in self.block(k):
                    if key >= first and key_id(key) != doc_id:
                        return out
                    if key_id(key) == doc_id:
                        out.append(np.frombuffer(ids, f"<u{self.width}"))
        return out


# -- encoding -----------------------------------------------------------------------------------------------------


class LibraryEncoder:
    """The tokenizers library behind a bounded table of words. No id of the vocabulary spans a space or a line feed.

    New words go to the library many at a time, parted by a character that is a word and an id of its own, so that it
    normalises a few long texts, not each word. Special tokens would cut its input into as many texts as there are words.
    Words and their ids stay in Arrow arrays; no word becomes a Python object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = next(((c, ids[0]) for c in MARKS if len(ids := self._ids(c)) == 1 and self._parts(c, ids)), (None, None))
        self._empty()

    def _empty(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, mark: str, ids: list[int]) -> bool:
        """Whether the mark, between spaces, leaves the ids of its neighbours as they are."""
        return all(self._ids(f"{a} {mark} {b}") == self._ids(a) + ids + self._ids(b) for a in PROBES for b in PROBES)

    def _packed(self, ids: Iterable[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _alone(self, words: pa.Array) -> pa.Array:
        return pa.array([self._packed(self._ids(w)) for w in words.to_pylist()], pa.large_binary())

    def _together(self, words: pa.Array) -> pa.Array:
        """The packed ids of words without the mark and special tokens."""
        stops = np.append(np.arange(0, len(words), GROUP), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(stops.astype(np.int32), words), pa.scalar(f" {self.mark} ", words.type))
        out = []
        for i in range(0, len(texts), 64):
            for k, got in enumerate(self.tokenizer.encode_batch_fast(texts[i : i + 64].to_pylist(), add_special_tokens=False), i):
                ids, group = np.array([*got.ids, self.mark_id], f"<u{self.width}"), words[k * GROUP : (k + 1) * GROUP]
                ends = np.flatnonzero(ids == self.mark_id)
                if len(ends) == len(group):
                    ends = np.append(0, ends - np.arange(len(ends))) * self.width
                    out.append(pa.Array.from_buffers(pa.large_binary(), len(group), [None, pa.py_buffer(ends), pa.py_buffer(ids[ids != self.mark_id])]))
                else:  # a word has the mark's id without the mark
                    out.append(self._alone(group))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def learn(self, words: pa.Array) -> np.ndarray:
        """Where the words, each once, now stand in the table."""
        at = pc.index_in(words, value_set=self.words)
        fresh = at.is_null()
        new = words.filter(fresh)
        if len(self.words) + len(new) > MOST_WORDS or sum(pc.sum(pc.binary_length(x)).as_py() or 0 for x in (self.words, new)) > MOST_LETTERS:
            self._empty()
            new, fresh = words, pa.array(np.full(len(words), True))
        apart = np.full(len(new), self.mark is None)
        for x in (*self.special, *filter(None, [self.mark])):
            apart |= pc.match_substring(new, x).to_numpy(zero_copy_only=False)
        rest, alone = new.filter(pa.array(~apart)), new.filter(pa.array(apart))
        places = np.empty(len(new), np.int64)
        places[np.argsort(apart, kind="stable")] = np.arange(len(self.words), len(self.words) + len(new))
        out = at.fill_null(0).to_numpy().astype(np.int64)
        out[fresh.to_numpy(zero_copy_only=False)] = places
        if len(new):
            self.words = pa.concat_arrays([self.words, rest, alone])
            self.ids = pa.concat_arrays([self.ids, self._together(rest), self._alone(alone)])
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text, null as empty."""
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        words = cut.values.dictionary_encode()
        at = self.learn(words.dictionary)
        _, stops, data = self.ids.take(pa.array(at[words.indices.to_numpy()])).buffers()
        stops, data = np.frombuffer(stops, np.int64)[cut.offsets.to_numpy()].tolist(), memoryview(data or b"")
        for a, b in zip(stops, stops[1:]):
            yield bytes(data[a:b])


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# -- shards -------------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards now. Returns their manifest: shard, path, n_docs, n_tokens, first_token (ids of all shards before).

    There is a shard for about each shard_bytes of text, so what a writer holds doesn't grow with the table; small tables have
    one for each task that can run at once. The tie columns keep a repeated id from filling one range."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "h", "tie"]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col].cast("string"))), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        shard, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        name, own = f"{root}/shard-{shard:06d}.sst", f"{root}/.{uuid.uuid4().hex}"
        end, number, before = np.array([end_id], f"<u{coder.width}").tobytes(), 0, None
        with files.open_output_stream(own) as out:
            writer = Writer(out, coder.width)
            for batch in small_batches(batches, most=8 << 20):
                for doc_id, h, ids in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), coder.encode_all(batch.column("text"))):
                    h += 1 << 63  # as bytes it sorts as Spark sorts it
                    number = number + 1 if before == (doc_id, h) else 0
                    before = doc_id, h
                    writer.add(make_key(doc_id, h, number), ids + end)
            writer.close()
        files.move(own, name)
        if writer.docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/shard-{shard:06d}.sst"], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    manifest = written(on_batches(dealt, run, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                files, name = store(path)
                rows: list[tuple] = []
                with files.open_input_file(name) as source:
                    reader = Reader(source)
                    for key, ids in reader:
                        n = len(ids) // reader.width
                        wide = np.frombuffer(ids, f"<u{reader.width}").astype("<u4").tobytes()
                        rows.append((key_id(key), start, n, zlib.crc32(wide)))
                        start += n
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    n = manifest.count()  # of shards
    spread = manifest.select("shard", "path", "first_token").repartition(max(1, n), "shard")
    return on_batches(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])
