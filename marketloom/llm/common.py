"""What the text operators share: table access, the cluster's shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.shipping import ship

#: A word, in every operator of this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine is made only where none is configured and there
    are no other machines (tests); on a cluster the setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and losing an executor costs nothing. The table goes when
    the application ends, or when it is discarded."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    files, place = _hadoop(df.sparkSession, path)
    files.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(table: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        files, place = _hadoop(table.sparkSession, folder)
        files.delete(place, True)


def on_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text, or one row; bounds what a vectorised step holds."""
    for batch in batches:
        begin = size = 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            if i > begin and size + (n or 0) > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
