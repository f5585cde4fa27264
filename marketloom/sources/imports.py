"""Watch lists of users: text, CSV and XLSX files with or without a header, codes or names."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.codes import import_code
from marketloom.functions.shipping import ship

# Headers, separators, encodings in their order, and most bytes of a file and of pasted text.
CODE_HEADERS = ("code", "股票代码", "代码", "stock_code", "symbol")
NAME_HEADERS = ("name", "股票名称", "名称", "stock_name")
SEPARATORS = (",", "\t", ";", "|")
ENCODINGS = ("utf-8-sig", "gbk")
MOST_FILE, MOST_TEXT = 2 << 20, 100 << 10

_LIKE = re.compile(r"(?i)^(\d{5,6}|\d{5,6}\s*\.(SH|SZ|SS)|[A-Z]{1,5}(\.[A-Z])?|(SH|SZ|SS)\d{6}|HK\d{5})$")


def _cells_of_text(text: str) -> list[list[str]]:
    """Lines as cells, by the separator that most lines hold; without one, a code and a name with a space between are two."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    best = max(SEPARATORS, key=lambda s: sum(s in x for x in lines))
    if any(best in x for x in lines):
        return [[c.strip() for c in row] for row in csv.reader(lines, delimiter=best)]
    out = []
    for x in lines:
        parts = x.split(None, 1)
        out.append(parts if len(parts) == 2 and _LIKE.match(parts[0]) and not all(map(_LIKE.match, parts[1].split())) else [x])
    return out


def _cells_of_workbook(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as text."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min(n for n in names if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: list[str] = []
            for c in row.iter(f"{ns}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * (max(at, len(cells) + 1) - len(cells) - 1)
                value = c.find(f"{ns}v")
                text = "" if value is None else value.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" and text else "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else text)
            out.append([x.strip() for x in cells])
    return out


def entries(content: bytes, name: str = "") -> list[tuple[int, str | None, str | None]]:
    """(line, code, name) of a list's rows, as they are written. A header names the columns; without one the first is the code."""
    if len(content) > MOST_FILE:
        raise ValueError(f"{name} has more than {MOST_FILE} bytes")
    if content[:4] == b"PK\x03\x04":
        rows = _cells_of_workbook(content)
    elif name.lower().endswith(".xls"):
        raise ValueError("only .xlsx workbooks can be read")
    else:
        for encoding in ENCODINGS:
            try:
                rows = _cells_of_text(content.decode(encoding))
                break
            except UnicodeDecodeError:
                continue
        else:
            raise ValueError(f"{name} is neither UTF-8 nor GBK")
    head = [x.lower() for x in rows[0]] if rows else []
    code_at, name_at = (next((i for i, x in reversed([*enumerate(head)]) if x in known), None) for known in (CODE_HEADERS, NAME_HEADERS))
    first = 0
    if code_at is None and name_at is None:
        code_at, name_at = 0, 1
    else:
        first = 1
    out = []
    for line, row in enumerate(rows[first:], first + 1):
        code, label = (row[k] or None if k is not None and k < len(row) else None for k in (code_at, name_at))
        if code or label:
            out.append((line, code, label))
    return out


def watch_lists(spark: SparkSession, path: str, instruments: DataFrame | None = None) -> DataFrame:
    """file, line, code, name of the lists at a path. What isn't a code is a name, and a name that stands for one instrument
    only (code, name) gives its code; unresolved rows have a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(file, *x) for x in entries(content, file)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file", "line", "first", "second"])

    ship(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line int, first string, second string")
    return resolved(rows, instruments)


def resolved(rows: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """rows: first and second cell, and others. Adds code and name in place of the two."""
    swapped = F.col("first").isNull() & import_code(F.col("second")).isNotNull()
    df = rows.withColumns({"code": F.when(swapped, import_code(F.col("second"))).otherwise(import_code(F.col("first"))), "name": F.when(~swapped, F.col("second"))})
    df = df.withColumn("name", F.when(F.col("code").isNull() & F.col("name").isNull(), F.col("first")).otherwise(F.col("name"))).drop("first", "second")
    if instruments is None:
        return df
    unique = instruments.groupBy("name").agg(F.countDistinct("code").alias("_n"), F.min("code").alias("_code")).where("_n = 1").drop("_n")
    return df.join(unique, "name", "left").withColumn("code", F.coalesce("code", "_code")).drop("_code")
