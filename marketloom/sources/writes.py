"""Write semantics over Parquet tables: upserts, replacements, deletions, status changes.

Each function returns the table's next state as a DataFrame; `store` writes it beside the old one and swaps folders, so a
reader never sees half a table and a failed job leaves the old state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key in full; new keys are added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key wasn't there: what an upsert counts."""
    return new.join(old.select(*keys), keys, "left_anti")


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the new rows' keys go; new keys may have several rows."""
    return without_keys(old, new, keys).unionByName(new)


def without_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of usage, messages, histories and snapshots are only ever added; columns that either lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def snapshot_rows(blocks: DataFrame) -> DataFrame:
    """blocks: query_id, code, and any columns. Rows of the table of fundamental snapshots: the rest as a JSON payload."""
    rest = [c for c in blocks.columns if c not in ("query_id", "code")]
    return blocks.select("query_id", "code", F.to_json(F.struct(*rest)).alias("payload"))


def history_rows(results: DataFrame) -> DataFrame:
    """results: query_id, code, score, advice, dashboard (JSON). Rows of the analysis history, with its four prices."""
    from marketloom.functions.payloads import price_points

    return results.select("query_id", "code", "score", "advice", price_points(F.col("dashboard")).alias("p")).select("query_id", "code", "score", "advice", "p.*")


def report_files(lines: DataFrame, path: str) -> None:
    """lines: report, ord, value. A folder report=... with one text file for each report, its lines in order."""
    ordered = lines.repartition("report").sortWithinPartitions("report", "ord")
    ordered.select("report", "value").write.mode("overwrite").partitionBy("report").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in a folder that driver and executors share, of this machine only where there are no others (tests). It goes when
    the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    folder = f"{base}/{name}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return f"{folder}/data"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage; it goes when the application ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merge_news(old: DataFrame, new: DataFrame, key: str = "key", keep_first: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Upsert by key in which blanks don't replace values, and the first query id stays."""
    a, b = old.alias("a"), new.alias("b")
    filled = lambda c: F.nullif(F.col(c), F.lit("")) if dict(new.dtypes)[c.split(".")[1]] == "string" else F.col(c)
    cols = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for c in old.columns:
        if c != key:
            cols.append((F.coalesce(f"a.{c}", f"b.{c}") if c in keep_first else F.coalesce(filled(f"b.{c}"), F.col(f"a.{c}"))).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols)


def replace_date(path: str, rows: DataFrame, column: str = "trade_date") -> None:
    """Replaces whole partitions of a table: those of the dates in rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the ids (a column `id`) and what refers to them."""
    return parents.join(ids, "id", "left_anti"), children.join(ids.select(F.col("id").alias(fk)), fk, "left_anti")


def invalidate_from(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Cached snapshots older than the first change of their account; changes: account, on."""
    first = changes.groupBy("account").agg(F.min("on").alias("_from"))
    return snapshots.join(first, "account", "left").where(F.col("_from").isNull() | (F.col("on") < F.col("_from"))).drop("_from")


#: Which status of a screening run may follow which.
ALLOWED = {
    "pending": ("resolving_universe", "failed"), "resolving_universe": ("ingesting", "failed"), "ingesting": ("factorizing", "failed"), "factorizing": ("screening", "failed"),
    "screening": ("ai_enriching", "completed", "failed"), "ai_enriching": ("completed", "completed_with_ai_degraded", "failed"), "failed": ("pending", "ingesting", "factorizing"), "completed": (), "completed_with_ai_degraded": (),
}


def allowed(status: Column, to: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in ALLOWED.items() for b in bs]
    return F.concat(status, F.lit(">"), to).isin(*pairs)


def change_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs: run_id, status; changes: run_id, to. Adds accepted; a change that isn't allowed leaves the status."""
    ok = F.coalesce(allowed(F.col("status"), F.col("to")), F.lit(False))
    return runs.join(changes, "run_id", "left").select("run_id", F.when(ok, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(F.col("to").isNotNull(), ok).alias("accepted"))


def store(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    own = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(own)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(f"{own}.old"))
    fs.rename(hadoop(own), hadoop(path))
    fs.delete(hadoop(f"{own}.old"), True)


# -- reading ------------------------------------------------------------------------------------------------------

#: Column names of the sources of bars, and what their units are multiplied by.
SOURCES = {
    "tushare": ({"trade_date": "date", "vol": "volume"}, {"volume": 100.0, "amount": 1000.0}),
    "efinance": ({"股票代码": "code", "日期": "date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "涨跌幅": "pct_chg"}, {}),
    "akshare": ({"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "涨跌幅": "pct_chg"}, {}),
    "baostock": ({"pctChg": "pct_chg"}, {}),
    "yfinance": ({"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}, {}),
    "pytdx": ({"datetime": "date", "vol": "volume"}, {}),
}
BAR = ("open", "high", "low", "close", "volume", "amount", "pct_chg")


def normalize_source(raw: DataFrame, source: str) -> DataFrame:
    """code, date and BAR of a source's rows: renamed, scaled, missing amounts from volume and close, missing changes from
    the close before; rows without close or volume go."""
    names, scale = SOURCES[source]
    back = {v: k for k, v in names.items()}
    col = lambda c: F.col(f"`{back[c]}`") if back.get(c) in raw.columns else F.col(c) if c in raw.columns else F.lit(None)
    df = raw.select(col("code").alias("code"), col("date").cast("string").try_cast("date").alias("date"), *((col(c).cast("string").try_cast("double") * scale.get(c, 1.0)).alias(c) for c in BAR))
    df = df.dropna(subset=["close", "volume"])
    for c in ("open", "high", "low"):
        df = df.withColumn(c, F.coalesce(c, "close"))
    change = (F.try_divide("close", F.lag("close").over(Window.partitionBy("code").orderBy("date"))) - 1) * 100
    return df.withColumns({"amount": F.coalesce("amount", F.col("volume") * F.col("close")), "pct_chg": F.coalesce("pct_chg", change, F.lit(0.0))})


def failover(sources: list[DataFrame]) -> DataFrame:
    """For each code the rows of the first source that has any."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("_p", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    return every.withColumn("_m", F.min("_p").over(Window.partitionBy("code"))).where("_p = _m").drop("_m").withColumnRenamed("_p", "source")
