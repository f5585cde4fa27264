"""Bars as a source: date ranges, cleaning, prefetching, and a data source of files by symbol for spark.read.format."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NUMBERS = ("open", "high", "low", "close", "volume", "amount", "pct_chg")


def date_range(bars: DataFrame, code: str | None = None, start: datetime.date | str | None = None, end: datetime.date | str | None = None, days: int | None = None) -> DataFrame:
    """Bars of a code between two days, both included. Without a start it is twice `days` calendar days before the end, so that
    there are about so many trading days. The filters reach the scan."""
    if start is None and days is not None:
        start = F.date_sub(F.lit(end).cast("date") if end is not None else F.current_date(), 2 * days)
    for bound, keep in ((code, lambda x: F.col("code") == x), (start, lambda x: F.col("date") >= (x if not isinstance(x, (str, datetime.date)) else F.lit(x).cast("date"))), (end, lambda x: F.col("date") <= F.lit(x).cast("date"))):
        if bound is not None:
            bars = bars.where(keep(bound))
    return bars


def clean(raw: DataFrame) -> DataFrame:
    """code, date and NUMBERS as they should be: days and numbers that are none become null, and rows without a day, close or
    volume go."""
    df = raw.select(*(c for c in raw.columns if c not in (*NUMBERS, "date")), F.col("date").cast("string").try_cast("date").alias("date"), *(F.col(c).cast("string").try_cast("double").alias(c) for c in NUMBERS if c in raw.columns))
    return df.dropna(subset=["date", "close", "volume"])


def prefetched(quotes: DataFrame, codes: Sequence[str], least: int = 5) -> DataFrame:
    """Quotes of some codes. From `least` codes on the whole table is read once and kept, since more will be asked of it."""
    source = quotes.cache() if len(codes) >= least else quotes
    return source.where(F.col("code").isin(*codes))


SPLIT_BYTES = 64 << 20
CELLS = ("date", "open", "high", "low", "close", "volume")
ROWS = pa.schema([("code", pa.string()), ("date", pa.date32()), *((c, pa.float64()) for c in CELLS[1:])])
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class _Files(InputPartition):
    """Files that one task reads: code and path of each."""

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files)
        self.files = files


def _code_of(path: str) -> str:
    """By a folder code=..., as Spark writes them, else by the file's name."""
    *folders, name = path.split("/")
    named = [x[5:] for x in folders if x.startswith("code=")]
    return unquote(named[-1]) if named else name[: -len(".csv")].upper()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def _listed(uri: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Every CSV file below a folder, by path. Names that begin with a dot or an underscore are none, as elsewhere in Spark."""
    store, folder = _place(uri)
    found = store.get_file_info(pafs.FileSelector(folder, recursive=True))
    return store, sorted((f for f in found if f.is_file and f.base_name.endswith(".csv") and f.base_name[0] not in "._"), key=lambda f: f.path)


def _dealt(files: Iterable[pafs.FileInfo], most: int) -> list[InputPartition]:
    """Neighbouring files share a task up to `most` bytes, so many small files aren't many tasks."""
    out: list[InputPartition] = []
    held: list[tuple[str, str]] = []
    size = 0
    for f in files:
        if held and size + f.size > most:
            out.append(_Files(held))
            held, size = [], 0
        held.append((_code_of(f.path), f.path))
        size += f.size
    return [*out, _Files(held)] if held else out


def _days(cells: pa.Array) -> pa.Array:
    """Days written as 2026-01-31; what is none is null, also one that the calendar lacks."""
    days = pc.strptime(cells, format="%Y-%m-%d", unit="s", error_is_null=True)
    return pc.if_else(pc.equal(pc.strftime(days, format="%Y-%m-%d"), cells), days, None).cast(pa.date32())


def _rows_of(store: pafs.FileSystem, code: str, path: str, start: datetime.date | None = None, end: datetime.date | None = None) -> Iterator[pa.RecordBatch]:
    """A file's bars, block by block. Missing columns and cells that are no numbers are null; rows without a day go if there are bounds."""
    convert = csv.ConvertOptions(column_types={c: pa.string() for c in CELLS}, include_columns=list(CELLS), include_missing_columns=True, strings_can_be_null=False)
    if store.get_file_info(path).size == 0:
        return
    with store.open_input_stream(path) as stream, csv.open_csv(stream, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=convert) as blocks:
        for block in blocks:
            cells = [pc.utf8_trim_whitespace(block.column(c)) for c in CELLS]
            numbers = [pc.if_else(pc.match_substring_regex(x, NUMBER), x, None).cast(pa.float64()) for x in cells[1:]]
            rows = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(code), len(block)), _days(cells[0]), *numbers], schema=ROWS)
            if start is not None:
                rows = rows.filter(pc.greater_equal(rows.column("date"), pa.scalar(start, pa.date32())))
            if end is not None:
                rows = rows.filter(pc.less_equal(rows.column("date"), pa.scalar(end, pa.date32())))
            yield rows


class _BarReader(DataSourceReader):
    """Codes choose files before any is opened, days choose rows before they leave Arrow.

    Both are options, not pushFilters: in Spark 4.1 what one plan of a DataFrame has pushed stays in force for another plan of
    the same DataFrame that pushes nothing, which then lacks rows."""

    def __init__(self, uri: str, most: int, codes: set[str] | None, start: datetime.date | None, end: datetime.date | None):
        self.uri, self.most, self.codes, self.start, self.end = uri, most, codes, start, end

    def partitions(self) -> Sequence[InputPartition]:
        files = (f for f in _listed(self.uri)[1] if self.codes is None or _code_of(f.path) in self.codes)
        return _dealt(files, self.most) or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.uri)
        for code, path in partition.files:
            yield from _rows_of(store, code, path, self.start, self.end)


class _BarStream(DataSourceStreamReader):
    """Files in order of (time changed, path); an offset is the last one given. A file that is written anew is given again, so
    that its bars can be merged by key. Files younger than `settle` seconds wait, since others of their moment may follow."""

    def __init__(self, uri: str, most: int, settle: float):
        self.uri, self.most, self.settle = uri, most, settle

    def _between(self, start: dict, end: dict) -> list[pafs.FileInfo]:
        at = lambda o: (o["changed"], o["path"])
        return [f for f in _listed(self.uri)[1] if at(start) < (f.mtime_ns, f.path) <= at(end)]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        settled = int((datetime.datetime.now(datetime.timezone.utc).timestamp() - self.settle) * 1e9)
        last = max(((f.mtime_ns, f.path) for f in _listed(self.uri)[1] if f.mtime_ns <= settled), default=(0, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt(self._between(start, end), self.most)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.uri)
        for code, path in partition.files:
            yield from _rows_of(store, code, path)


class BarFiles(DataSource):
    """Daily bars of a shared folder with CSV files by symbol: spark.read.format("bar_files").load(folder), or readStream. The folder may
    be on any file system that pyarrow.fs names by a URI. Options: codes (a JSON list), start and end (days, both included);
    split_bytes, how much one task reads; settle, seconds that a stream leaves to new files. `of_files` sets them. A user's own source is another subclass, registered in the same way."""

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return "code string, date date, open double, high double, low double, close double, volume double"

    def _most(self) -> int:
        return int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        codes, days = self.options.get("codes"), [self.options.get(x) for x in ("start", "end")]
        return _BarReader(self.options["path"], self._most(), None if codes is None else set(json.loads(codes)), *(None if d is None else datetime.date.fromisoformat(d) for d in days))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _BarStream(self.options["path"], self._most(), float(self.options.get("settle", 2)))


def register(spark: SparkSession, source: type[DataSource] = BarFiles) -> None:
    from marketloom.functions.shipping import ship

    ship(spark)
    spark.dataSource.register(source)


def of_files(spark: SparkSession, folder: str, codes: Iterable[str] | None = None, start: datetime.date | str | None = None, end: datetime.date | str | None = None) -> DataFrame:
    """Bars of a folder of CSV files. Only the files of these codes are opened."""
    register(spark)
    chosen = {"codes": None if codes is None else json.dumps(sorted(codes)), "start": start, "end": end}
    return spark.read.format("bar_files").options(**{k: str(v) for k, v in chosen.items() if v is not None}).load(folder)
