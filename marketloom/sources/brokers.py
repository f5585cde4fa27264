"""Brokers' trade files: encodings, header names by broker, normal records with a hash that finds repeats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.codes import canonical
from marketloom.functions.text import dedup_hash, trade_side
from marketloom.sources.writes import kept


class Broker(NamedTuple):
    """Header names of each field, the first that is filled counts."""

    aliases: tuple[str, ...]
    title: str
    date: tuple[str, ...]
    symbol: tuple[str, ...]
    side: tuple[str, ...]
    quantity: tuple[str, ...]
    price: tuple[str, ...]
    uid: tuple[str, ...]


# Headers of three brokers, those that are looked for in any file after them, headers that are summed.
BROKERS: dict[str, Broker] = {
    "huatai": Broker((), "华泰", ("成交日期", "成交时间", "发生日期", "日期"), ("证券代码", "股票代码", "代码"), ("买卖标志", "买卖方向", "操作"), ("成交数量", "数量", "成交股数"), ("成交均价", "成交价格", "价格", "成交价", "均价"), ("成交编号", "成交序号", "流水号")),
    "citic": Broker(("zhongxin",), "中信", ("发生日期", "成交日期", "日期"), ("证券代码", "股票代码", "代码"), ("买卖方向", "买卖标志", "业务名称"), ("成交数量", "数量", "成交股数"), ("成交价格", "成交均价", "价格", "成交价"), ("合同编号", "成交编号", "委托编号")),
    "cmb": Broker(("zhaoshang", "cmbchina"), "招商", ("日期", "成交日期", "发生日期"), ("证券代码", "股票代码", "代码"), ("交易方向", "买卖方向", "买卖标志"), ("成交股数", "成交数量", "数量"), ("成交价", "成交价格", "成交均价", "均价"), ("流水号", "成交编号", "成交序号")),
}
ANY = Broker((), "", ("成交日期", "发生日期", "日期", "成交时间"), ("证券代码", "股票代码", "代码"), ("买卖标志", "买卖方向", "交易方向", "业务名称", "操作"), ("成交数量", "数量", "成交股数"), ("成交均价", "成交价格", "价格", "成交价", "均价"), ("成交编号", "成交序号", "合同编号", "委托编号", "流水号"))
FEES, TAXES, CURRENCY = ("手续费", "佣金", "交易费", "规费", "过户费"), ("印花税", "税费", "其他税费"), ("币种", "货币")


def register(name: str, broker: Broker) -> None:
    """Adds or replaces a broker; an alias may stand for one broker only."""
    key = name.strip().lower()
    for alias in broker.aliases:
        if alias == key or (alias in (known := aliases()) and known[alias] != key):
            raise ValueError(f"alias {alias!r} is taken")
    BROKERS[key] = broker


def aliases() -> dict[str, str]:
    return {a: name for name, b in BROKERS.items() for a in b.aliases}


def broker_of(name: str) -> Broker:
    key = name.strip().lower()
    key = aliases().get(key, key)
    if key not in BROKERS:
        raise ValueError(f"unknown broker {name!r}")
    return BROKERS[key]


def _splits(df: DataFrame, value: str) -> Column:
    """Sum of a value over the splits of a file that come before each; df has a row for each split."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, line (the header is line 1), cells: each row as a map of header to text. Files are read in byte ranges, each by a task of its
    own: a line begins a row where the quotes before it in the file are even in number, which follows from the counts of the ranges
    before and of the lines before in its own range; rows are numbered in the same way. A row with line breaks inside quotes is put
    together from its lines, wherever the ranges part them. Blank lines don't count. A file that isn't UTF-8 is taken for GB 18030, which
    holds GBK; one that is neither fails."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))  # bytes, whatever the encoding
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"), (quotes % 2).alias("odd"), F.is_valid_utf8("value").alias("utf8"), (F.trim(F.rtrim(F.translate("value", "\r\ufeff", ""))) == "").alias("blank"))
    lines = kept(lines, "lines")
    own = Window.partitionBy("file", "split").orderBy("at")
    before = lambda c: F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"))
    splits = splits.select("file", "split", _splits(splits, "odd").alias("odd_before"))
    plain = lines.groupBy("file").agg(F.bool_and("utf8").alias("plain"))
    text = F.when(F.col("plain"), F.decode("raw", "UTF-8")).otherwise(F.decode("raw", "GB18030"))
    setting = "spark.sql.legacy.javaCharsets"
    usual = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")  # decode() takes this charset only where the setting held when the plan was made
    try:
        lines = lines.join(splits, ["file", "split"]).withColumn("begins", ((F.col("odd_before") + before("odd")) % 2 == 0).cast("int")).where("NOT (blank AND begins = 1)")
        lines = kept(lines.join(plain, "file").select("file", "split", "at", "begins", text.alias("text")), "lines")
    finally:
        spark.conf.set(setting, usual)
    splits = lines.groupBy("file", "split").agg(F.sum("begins").alias("begun"))
    splits = splits.select("file", "split", _splits(splits, "begun").alias("begun_before"))
    upto = F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.join(splits, ["file", "split"]).withColumn("line", F.col("begun_before") + upto)
    rows = rows.groupBy("file", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("split", "at", "text"))), lambda x: x["text"]).alias("parts"))
    rows = kept(rows.select("file", F.col("line").cast("int").alias("line"), F.regexp_replace(F.regexp_replace(F.array_join("parts", "\n"), "\r$", ""), "^\ufeff", "").alias("row")), "rows")
    heads = rows.where("line = 1").select("file", F.col("row").alias("head"))
    widest = heads.agg(F.max(F.length("head") - F.length(F.replace("head", F.lit(","), F.lit(""))))).first()[0]
    columns = ", ".join(f"c{i} string" for i in range((widest or 0) + 1))
    cut = lambda c: F.from_csv(c, columns, {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"})
    cells = lambda c: F.array(*(F.coalesce(F.col(f"{c}.c{i}"), F.lit("")) for i in range((widest or 0) + 1)))
    heads = heads.withColumn("h", cut("head")).select("file", cells("h").alias("names"))
    found = rows.where("line > 1").withColumn("x", cut("row")).join(heads, "file").select("file", "line", "names", cells("x").alias("values"))
    pairs = F.filter(F.arrays_zip("names", "values"), lambda x: x["names"] != "")
    # of a name that occurs again only the first column counts
    pairs = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["names"]), x["names"]) == i + 1)
    return found.select("file", "line", F.map_from_entries(pairs).alias("cells"))


def _cell(name: str) -> Column:
    t = F.trim(F.element_at("cells", F.lit(name)))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


DAYS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/M/d", "yyyy-M-d", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd HH:mm:ss")


def normalized(rows: DataFrame, broker: str) -> DataFrame:
    """rows: line, cells and others, which stay. Records with a date, symbol, side, and a positive quantity and price; others
    go. Fees and taxes are sums of their columns. The line is part of the hash, so equal fills of one file stay apart."""
    own = broker_of(broker)
    pick = lambda field: F.coalesce(*map(_cell, dict.fromkeys((*getattr(own, field), *getattr(ANY, field)))))
    total = lambda names: sum((F.coalesce(_number(_cell(c)), F.lit(0.0)) for c in names), F.lit(0.0))
    day = pick("date")
    df = rows.withColumns({
        "date": F.to_date(F.coalesce(*(F.try_to_timestamp(day, F.lit(p)) for p in DAYS))), "symbol": canonical(pick("symbol")), "side": trade_side(pick("side")), "quantity": _number(pick("quantity")), "price": _number(pick("price")),
        "fee": total(FEES), "tax": total(TAXES), "trade_uid": pick("uid"), "currency": F.upper(F.coalesce(*map(_cell, CURRENCY))),
    })
    df = df.where(F.col("date").isNotNull() & (F.col("symbol") != "") & F.col("side").isNotNull() & (F.col("quantity") > 0) & (F.col("price") > 0)).drop("cells")
    sized = [F.format_string("%.8f", c) for c in ("quantity", "price", "fee", "tax")]
    return df.withColumn("dedup_hash", dedup_hash(F.col("date"), F.col("symbol"), F.col("side"), *sized, F.col("currency"), F.col("line")))


def trade_files(spark: SparkSession, path: str, broker: str) -> DataFrame:
    return normalized(read_files(spark, path), broker)
