"""Tables whose partitions change together: a log of versions beside Parquet folders, on any Hadoop file system.

A commit writes new folders for the partitions that it replaces, in as many tables as it likes, and then adds one entry to the log.
The entry says which folder holds each partition of each table from then on, and how far each stream has come. Adding it is the
commit: a writer that dies before leaves the old version in all tables, and a batch that runs again after it does nothing. Readers take the
folders of one entry, so they see one version of all tables however long they read. An entry is a row for each partition, so tables
should have thousands of partitions at most (a month, a hash of the account), whatever their rows.

Two writers may commit at once: the later one keeps what the other has changed, unless both replaced the same partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.sources.writes import kept

PART = "_part"


class Conflict(RuntimeError):
    """Another commit replaced a partition that this one replaces too."""


@dataclass
class Version:
    number: int = -1
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """rows with a column PART (text): they take the place of the partitions `parts`. Of those, what has no row becomes empty."""

    rows: DataFrame
    parts: Sequence[str]


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log ------------------------------------------------------------------------------------------------------

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._place(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The number of the newest version, -1 for none."""
        files, log = self._files(), self._place(f"{self.root}/log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def version(self, number: int | None = None) -> Version:
        number = self.latest() if number is None else number
        if number < 0:
            return Version()
        stream = self._files().open(self._place(f"{self.root}/log/{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def _add(self, v: Version) -> bool:
        """Whether the entry could be added: the file is written under another name and renamed, which fails where it is there."""
        files = self._files()
        body = json.dumps({"tables": v.tables, "schemas": v.schemas, "batches": v.batches})
        own = self._place(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = files.create(own, False)
        out.write(bytearray(body.encode()))
        out.close()
        to = self._place(f"{self.root}/log/{v.number:020d}.json")
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(own), files.makeQualified(to), none)
            return True
        except Exception as e:
            files.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # -- reading and writing ------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | Version | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """A table at a version (None: the newest), without PART; only the given partitions, if any are named."""
        v = version if isinstance(version, Version) else self.version(version)
        schema = StructType.fromJson(v.schemas[table])
        there = v.tables[table]
        folders = [f"{self.root}/{there[p]}" for p in (there if parts is None else parts) if p in there]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], base: Version | None = None, stream: str = "", batch: int = -1) -> int:
        """Replaces partitions of tables in one step; base: the version that the rows were made from. Returns the new version's number,
        or that of the present one if this batch of the stream is in it."""
        base = base or self.version()
        if batch >= 0 and base.batches.get(stream, -1) >= batch:
            return base.number
        folders: dict[str, dict[str, str | None]] = {}
        for table, change in changes.items():
            own = f"data/{table}/{uuid.uuid4().hex}"
            change.rows.write.partitionBy(PART).parquet(f"{self.root}/{own}")
            status = self._files().listStatus(self._place(f"{self.root}/{own}"))
            names = {s.getPath().getName().removeprefix(f"{PART}=") for s in status if s.isDirectory()}
            stray = names - set(change.parts)
            if stray:
                raise ValueError(f"rows of {table} in partitions that the change doesn't name: {sorted(stray)[:5]}")
            folders[table] = {p: f"{own}/{PART}={p}" if p in names else None for p in change.parts}
        now = base
        while True:
            new = Version(now.number + 1, {t: dict(x) for t, x in now.tables.items()}, dict(now.schemas), dict(now.batches))
            for table, parts in folders.items():
                there = new.tables.setdefault(table, {})
                new.schemas[table] = json.loads(changes[table].rows.drop(PART).schema.json())
                for p, folder in parts.items():
                    if there.get(p) != base.tables.get(table, {}).get(p):
                        raise Conflict(f"partition {p} of {table} was replaced by version {now.number}")
                    there.pop(p, None)
                    if folder:
                        there[p] = folder
            if batch >= 0:
                new.batches[stream] = batch
            if self._add(new):
                return new.number
            now = self.version()
            if batch >= 0 and now.batches.get(stream, -1) >= batch:
                return now.number

    def vacuum(self, keep: int = 10) -> int:
        """Deletes entries but the newest `keep`, and folders that those don't name. No writer may be at work."""
        files, last = self._files(), self.latest()
        held = [self.version(n) for n in range(max(0, last - keep + 1), last + 1)]
        named = {folder for v in held for parts in v.tables.values() for folder in parts.values()}
        gone = 0
        for status in files.globStatus(self._place(f"{self.root}/data/*/*/{PART}=*")) or []:
            path = status.getPath()
            if "/".join(path.toString().split("/")[-4:]) not in named:
                gone += bool(files.delete(path, True))
        for n in range(0, max(0, last - keep + 1)):
            files.delete(self._place(f"{self.root}/log/{n:020d}.json"), False)
        return gone


def bucket(column: str, n: int = 64) -> Column:
    return F.lpad(F.pmod(F.xxhash64(column), F.lit(n)).cast("string"), 4, "0")


def month(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def touched(rows: DataFrame, part: Column) -> list[str]:
    """The partitions that rows fall in: no more than the table has."""
    return sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())


def replace_keys(store: Versions, tables: dict[str, tuple[DataFrame, Sequence[str], Callable[[str], Column]]], gone: dict[str, DataFrame], part_of: str, base: Version | None = None) -> int:
    """For each table (rows, their key, how part_of becomes a partition): rows with the keys in gone[table] go, and the new rows come; all in one
    commit."""
    base = base or store.version()
    changes = {}
    for table, (rows, keys, part) in tables.items():
        rows, out = kept(rows, "rows"), kept(gone[table].select(*keys).distinct(), "gone")
        # the partition's column is one of the keys, so what goes and what comes lie in the same partitions
        parts = touched(out.select(part_of).unionByName(rows.select(part_of)), part(part_of))
        left = rows
        if table in base.tables:
            left = store.read(table, base, parts).join(out, list(keys), "left_anti").unionByName(rows)
        changes[table] = Change(left.withColumn(PART, part(part_of)), parts)
    return store.commit(changes, base)
