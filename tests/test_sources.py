"""Brokers' files, bars as a source, tools, write plans and fuzzy names, on small literal cases."""

import csv
import datetime as dt
import io
import difflib
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import history
from marketloom.plans import tools
from marketloom.sources import bars, brokers, writes

HUATAI = "成交日期,证券代码,买卖标志,成交数量,成交均价,成交编号,手续费,印花税\n2026-01-02,600519,买入,\"1,000\",10.5,A1,5,0\n\n20260103,600519,卖出,500,11,A2,-,1\n2026-01-04,600519,转托管,1,1,A3,0,0\n2026-01-04,,买入,1,1,A4,0,0\n"
CITIC = "发生日期,股票代码,业务名称,数量,成交价格,合同编号,佣金,币种\n2026-01-02,000001,证券买入,100,10,C1,1,cny\n2026-01-02,000001,证券买入,100,10,C1,1,cny\n"
CMB = "日期,代码,交易方向,成交股数,均价,流水号\n2026/1/5,000001,买,100,10,F1\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk", "gb18030"])
def test_broker_files(spark, tmp_path, encoding):
    (tmp_path / "h.csv").write_bytes(HUATAI.encode(encoding))
    rows = brokers.trade_files(spark, str(tmp_path / "h.csv"), "huatai").orderBy("line").collect()
    assert [(str(r.date), r.symbol, r.side, r.quantity, r.price, r.fee, r.tax, r.trade_uid, r.line) for r in rows] == [("2026-01-02", "600519", "buy", 1000.0, 10.5, 5.0, 0.0, "A1", 2), ("2026-01-03", "600519", "sell", 500.0, 11.0, 0.0, 1.0, "A2", 3)]
    (tmp_path / "c.csv").write_bytes(CITIC.encode(encoding))
    rows = brokers.trade_files(spark, str(tmp_path / "c.csv"), "zhongxin").collect()
    assert [(r.trade_uid, r.fee, r.currency) for r in rows] == [("C1", 1.0, "CNY")] * 2 and len({r.dedup_hash for r in rows}) == 2
    again = brokers.trade_files(spark, str(tmp_path / "c.csv"), "citic").collect()
    assert {r.dedup_hash for r in again} == {r.dedup_hash for r in rows}
    (tmp_path / "m.csv").write_bytes(CMB.encode(encoding))
    assert [(str(r.date), r.side, r.price) for r in brokers.trade_files(spark, str(tmp_path / "m.csv"), "cmb").collect()] == [("2026-01-05", "buy", 10.0)]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "gb18030"])
def test_large_broker_file_in_ranges(spark, tmp_path, encoding):
    """Against the csv module: quoted line breaks, commas and quotes at the edges of byte ranges, Chinese letters, blank and short rows."""
    rnd = random.Random(3)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(["日期", "说明", "数量", "说明"])
    for i in range(6000):
        w.writerow([f"2026-01-{i % 28 + 1:02d}", rnd.choice(["平", 'he said "yes, no"', "两\n行", "a\n\n,b\n\"\"\n", " spaced ", ""]), i, "again"][: rnd.choice([4, 4, 4, 2])])
        if i % 97 == 0:
            out.write("\r\n")
    data = out.getvalue().encode(encoding)
    (tmp_path / "big.csv").write_bytes(data)
    rows = [r for r in csv.reader(io.StringIO(out.getvalue(), newline="")) if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 20
        got = {r.line: r.cells for r in brokers.read_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 6000
    for k, row in enumerate(rows[1:]):
        want = dict(zip(["日期", "说明", "数量"], row + [""] * 3))
        assert {a: b.replace("\r", "") for a, b in got[k + 2].items()} == {a: b.replace("\r", "") for a, b in want.items()}, k


def test_broker_registry():
    own = brokers.BROKERS["cmb"]._replace(aliases=("zhongxin",))
    with pytest.raises(ValueError):
        brokers.register("mine", own)
    with pytest.raises(ValueError):
        brokers.broker_of("nobody")
    brokers.register("mine", own._replace(aliases=("my",)))
    assert brokers.broker_of(" MY ") == brokers.BROKERS["mine"]
    del brokers.BROKERS["mine"]


def test_bars_as_a_data_source(spark, tmp_path):
    for code in ("aaa", "bbb"):
        (tmp_path / f"{code}.csv").write_text("date,open,high,low,close,volume\n2026-01-02,1,2,0.5,1.5,100\n2026-01-05,,2,0.5,1.75,\n", encoding="utf-8")
    bars.register(spark)
    df = spark.read.format("bar_files").load(str(tmp_path))
    assert df.count() == 4 and df.where("code = 'BBB'").agg(F.sum("close")).first()[0] == 3.25
    assert bars.clean(df).count() == 2
    assert [r.date for r in bars.date_range(df, "AAA", "2026-01-03", "2026-01-05").collect()] == [dt.date(2026, 1, 5)]
    assert bars.date_range(df, "AAA", end="2026-01-05", days=1).count() == 1
    assert bars.prefetched(df, ["AAA"] * 5).count() == 2


def test_bar_files_open_what_is_asked_for(spark, tmp_path):
    text = "date,close,volume,other\n2026-01-02, 1.5 ,100,x\n2026-02-30,2,1,y\nsoon,n/a,1e2,\n2026-01-05,.5,,\"a\nb\"\n"
    for path in ("aaa.csv", "bbb.csv", "ccc.csv", "deep/code=d%3A1/part-0.csv", "_hidden.csv"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("\ufeff" + text, encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    got = bars.of_files(spark, f"file://{tmp_path}", ["AAA"]).select("date", "open", "close", "volume").collect()
    assert [(r.date and str(r.date), r.open, r.close, r.volume) for r in got] == [("2026-01-02", None, 1.5, 100.0), (None, None, 2.0, 1.0), (None, None, None, 100.0), ("2026-01-05", None, 0.5, None)]
    assert {r.code for r in bars.of_files(spark, str(tmp_path)).collect()} == {"AAA", "BBB", "CCC", "d:1"}
    source = bars.BarFiles({"path": str(tmp_path), "split_bytes": "1"})
    assert len(source.reader(None).partitions()) == 5
    for more, files, days in (({"codes": '["BBB"]'}, ["BBB"], 4), ({"codes": '["AAA", "CCC", "ZZZ"]'}, ["AAA", "CCC"], 8), ({"codes": "[]"}, [], 0), ({"codes": '["d:1"]', "start": "2026-01-03"}, ["d:1"], 1), ({"end": "2026-01-02", "codes": '["AAA"]'}, ["AAA"], 1)):
        reader = bars.BarFiles({**source.options, **more}).reader(None)
        assert sorted(c for p in reader.partitions() for c, _ in p.files) == files
        assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == days
    assert len(bars.BarFiles({"path": str(tmp_path)}).reader(None).partitions()) == 1


def test_bar_files_as_a_stream(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    bars.register(spark)

    def run() -> list[tuple]:
        spark.readStream.format("bar_files").option("settle", 0).load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.code, r.close) for r in spark.read.parquet(out).collect())

    (source / "b.csv").write_text("date,close\n2026-01-02,1\n")
    assert run() == [("B", 1.0)]
    (source / "a.csv").write_text("date,close\n2026-01-02,2\n")
    assert run() == [("A", 2.0), ("B", 1.0)]
    assert run() == [("A", 2.0), ("B", 1.0)]


def test_clean(spark):
    raw = spark.createDataFrame([("a", "2026-01-02", "1", "x", "5"), ("a", "soon", "1", "1", "5"), ("a", "2026-01-03", "", "1", "5"), ("a", "2026-01-04", "2", "1", None)], "code string, date string, close string, open string, volume string")
    assert [(r.code, str(r.date), r.close, r.open, r.volume) for r in bars.clean(raw).collect()] == [("a", "2026-01-02", 1.0, None, 5.0)]


def test_tools(spark):
    assert len(tools.TOOLS) == 16 and tools.TOOLS["get_daily_history"].parameters["required"] == ["code", "end"]
    b = spark.createDataFrame([("a", dt.date(2026, 1, d), float(d)) for d in range(1, 9)], "code string, date date, close double")
    assert [r.close for r in tools.execute("get_daily_history", b, code="a", end="2026-01-05", days=2).collect()] == [5.0, 4.0]
    for wrong in ({"code": 5, "end": "x"}, {"code": "a"}, {"code": "a", "end": "x", "what": 1}, {"code": "a", "end": "x", "days": True}):
        with pytest.raises(TypeError):
            tools.execute("get_daily_history", b, **wrong)
    with pytest.raises(KeyError):
        tools.execute("none", b)
    rows = tools.matching_rules(b, {"late": "close > 6", "even": "close % 2 = 0"}).collect()
    assert {r.close: r.rules for r in rows}[8.0] == ["late", "even"] and {r.close: r.rules for r in rows}[1.0] == []


def test_write_plans(spark, tmp_path):
    blocks = spark.createDataFrame([("q", "a", 1, None)], "query_id string, code string, pe int, pb double")
    assert writes.snapshot_rows(blocks).first().payload == '{"pe":1}'
    res = spark.createDataFrame([("q", "a", 70, "buy", '{"sniper_points":{"ideal_buy":"12元","stop_loss":9}}')], "query_id string, code string, score int, advice string, dashboard string")
    row = writes.history_rows(res).first()
    assert (row.ideal_buy, row.secondary_buy, row.stop_loss, row.take_profit) == (12.0, None, 9.0, None)
    both = writes.appended(writes.history_rows(res), spark.createDataFrame([("r",)], "query_id string"))
    assert both.count() == 2
    lines = [(name, k, f"{name}{k}") for k in (3, 1, 2) for name in ("a", "b")]
    writes.report_files(spark.createDataFrame(lines, "report string, ord int, value string").repartition(3), str(tmp_path / "r"))
    for name in ("a", "b"):
        files = list((tmp_path / "r" / f"report={name}").glob("*.txt"))
        assert [f.read_text() for f in files] == [f"{name}1\n{name}2\n{name}3\n"]


def test_run_ids_and_limits():
    a, b = history.run_id("cn", {"x": 1, "y": [2]}), history.run_id("cn", {"y": [2], "x": 1})
    assert a == b and a.startswith("run-") and len(a) == 36 and a != history.run_id("us", {"x": 1, "y": [2]})
    assert [history.news_top_m(n, k) for n, k in ((0, 3), (3, 5), (10, 3), (10, 8))] == [0, 3, 5, 8]
    with pytest.raises(ValueError):
        history.checked_limits(5, 6)


def test_fuzzy_names_by_brute_force(spark):
    rnd = random.Random(3)
    pool = ["贵州茅台", "平安银行", "中国平安", "招商银行", "宁德时代", "中国中免", "中国中车", "abc holdings", "abd holding", "zz", "Supplier#0012", "Supplier#0021"]
    known = list(dict.fromkeys(pool + ["".join(rnd.choices("abcdeé", k=rnd.randrange(1, 9))) for _ in range(150)]))
    asked = list(dict.fromkeys([x[:-1] + rnd.choice("abé行") for x in known[::2]] + [x[1:] + x[:1] for x in known[::5]] + ["".join(rnd.choices("abcdeé", k=rnd.randrange(1, 9))) for _ in range(60)]))
    want = {}
    for x in asked:
        best = None
        for i, y in enumerate(known):
            r = difflib.SequenceMatcher(None, x, y).ratio()
            if min(len(x), len(y)) > 2 and (r >= 0.8 or (r >= 0.7 and len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1)):
                best = max(best or (0, ""), (r, y))
        if best:
            want[x] = best[1]
    got = text.fuzzy_names(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([*zip(known, range(len(known)))], "known string, code int")).collect()
    assert {r.name: r.known for r in got} == want and len(want) > 40


def test_chunks_are_whole_and_full():
    rnd = random.Random(5)
    for _ in range(300):
        x = "".join(rnd.choice(["a", "é", "字", "\n", "word ", "👩"]) for _ in range(rnd.randrange(120)))
        for most in (4, 7, 30):
            parts = text.cut_bytes(x, most)
            assert all(len(p.encode()) <= most for p in parts)
            assert "".join(parts).replace("\n", "") == x.replace("\n", "")
            # no part could have taken the line that begins the next one
            lines, at = x.split("\n"), 0
            if all(len(line.encode()) <= most for line in lines):
                for p in parts:
                    n = p.count("\n") + 1
                    assert p == "\n".join(lines[at : at + n])
                    at += n
                    assert at == len(lines) or len(p.encode()) + 1 + len(lines[at].encode()) > most
                assert at == len(lines)


def workbook(rows):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        texts = [x for row in rows for x in row]
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in texts) + "</sst>")
        n, body = 0, ""
        for r, row in enumerate(rows, 1):
            body += f'<row r="{r}">'
            for c, x in enumerate(row):
                if x:
                    body += f'<c r="{chr(65 + c)}{r}" t="s"><v>{n}</v></c>'
                n += 1
            body += "</row>"
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_watch_lists(spark, tmp_path):
    from marketloom.sources import imports

    assert imports.entries("00700\n600519\n".encode()) == [(1, "00700", None), (2, "600519", None)]
    assert imports.entries("code\n00700\n".encode()) == [(2, "00700", None)]
    assert imports.entries("600519 贵州茅台\nAAPL Apple Computers\n00700 600000\n".encode("gbk")) == [(1, "600519", "贵州茅台"), (2, "AAPL", "Apple Computers"), (3, "00700 600000", None)]
    assert imports.entries("名称;代码\n平安银行;000001\n;\n".encode()) == [(2, "000001", "平安银行")]
    assert imports.entries(workbook([["股票代码", "x", "股票名称"], ["600519", "", "贵州茅台"], ["", "", "平安银行"]])) == [(2, "600519", "贵州茅台"), (3, None, "平安银行")]
    for bad in (b"\xff\xff\xff", b"x" * (imports.MOST_FILE + 1)):
        with pytest.raises(ValueError):
            imports.entries(bad)
    with pytest.raises(ValueError):
        imports.entries(b"1", "a.xls")
    (tmp_path / "a.csv").write_bytes("SH600519,贵州茅台\n,平安银行\n谁,\n".encode())
    (tmp_path / "b.xlsx").write_bytes(workbook([["hk00700", "腾讯"]]))
    names = spark.createDataFrame([("000001", "平安银行"), ("1", "谁"), ("2", "谁")], "code string, name string")
    got = {(r.code, r.name) for r in imports.watch_lists(spark, str(tmp_path), names).collect()}
    assert got == {("600519", "贵州茅台"), ("000001", "平安银行"), (None, "谁"), ("00700", "腾讯")}


def test_scores_of_overridden_signals(spark):
    from marketloom.functions import payloads

    rows = spark.createDataFrame([("buy", 0.0), ("buy", 1.0), ("hold", 0.25), ("sell", 2.0), ("odd", -1.0)], "s string, c double")
    got = [x[0] for x in rows.select(payloads.estimated_score(F.col("s"), F.col("c"))).collect()]
    assert got == [65, 79, round(45 + 14 * 0.25), 39, 45]
    steps = [[x[0] for x in rows.select(payloads.downgraded(F.col("s"), n)).collect()] for n in (0, 1, 2)]
    assert steps == [["buy", "buy", "hold", "sell", "odd"], ["hold", "hold", "sell", "sell", "odd"], ["sell"] * 4 + ["odd"]]
    assert rows.select(payloads.money_text(F.lit(1.234e8)), payloads.money_text(F.lit(12_345.0)), payloads.money_text(F.lit(999.0)), payloads.money_text(F.lit(None).cast("double"))).first()[0:4] == ("1.23 亿元", "1.23 万元", "999 元", "N/A")


def test_resumed_and_trimmed(spark):
    t = spark.createDataFrame([(i, s, dt.datetime(2026, 1, 1 + i // 3, i % 3)) for i, s in enumerate(["completed", "pending", "failed", "completed", "completed", "processing", "failed"])], "id long, status string, created_at timestamp")
    assert sorted(r.id for r in history.trimmed_tasks(t, 4).collect()) == [1, 4, 5, 6]
    assert history.trimmed_tasks(t, 7).count() == 7 and sorted(r.id for r in history.trimmed_tasks(t, 1).collect()) == [1, 5]
