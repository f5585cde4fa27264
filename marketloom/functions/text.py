"""Parsing and formatting of short texts: numbers, dates, prices, advice, labels."""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.shipping import ship
from marketloom.sources.writes import kept


def number(text: Column) -> Column:
    """A double, without thousands commas and percent signs; null for blanks, dashes and what is no number."""
    t = F.regexp_replace(F.trim(text), "[,%]", "")
    return F.when(t.isin("", "-", "--"), None).otherwise(t.try_cast("double"))


def price_point(text: Column) -> Column:
    """A price in prose. A text that is a number is that number. Else the last number between the last colon and the next 元, without its
    sign; else the last one before the first bracket, or of the whole text if it begins with one. Numbers right after MA don't count."""
    t = F.trim(F.regexp_replace(text, "[,，]", ""))
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    before_yuan = F.regexp_extract(t, r"(?s)^(?:.*[:：])?([^:：]*?)元[^:：]*$", 1)
    told = lambda s, sign: F.filter(F.regexp_extract_all(s, F.lit(rf"(?i)((?:MA)?{sign}\d+(?:\.\d+)?)"), F.lit(1)), lambda x: ~F.upper(x).startswith("MA"))
    last = lambda s, sign: F.abs(F.try_element_at(told(s, sign), F.lit(-1)).try_cast("double"))
    head = F.trim(F.regexp_extract(t, r"(?s)^([^(（]*)", 1))
    found = F.coalesce(plain, last(before_yuan, "-?"), last(F.when(head == "", t).otherwise(head), ""))
    return F.when(~t.isin("", "-", "—", "N/A"), found)


# Units of relative dates in seconds, names of months, zones of mail dates in hours.
_UNITS = {"分钟": 60, "小时": 3600, "天": 86400, "周": 7 * 86400, "个月": 30 * 86400, "月": 30 * 86400, "年": 365 * 86400}
_ENGLISH = {"minute": 60, "minutes": 60, "min": 60, "mins": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400, "week": 7 * 86400, "weeks": 7 * 86400, "month": 30 * 86400, "months": 30 * 86400, "year": 365 * 86400, "years": 365 * 86400}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.nullif(key, F.lit("")))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, null where there is no such day."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.nullif(year, F.lit("")), month.cast("string"), F.nullif(day, F.lit(""))), F.lit("yyyy-M-d")))


def _by_month_name(t: Column) -> Column:
    """Days such as "Mon, 02 Jan 2023 15:04:05 GMT", "5 January 2023" or "Jan 5, 2023"; a zone moves them to the session's."""
    clock = r"(?:\s+(\d{1,2}:\d{2}(?::\d{2})?)(?:\s+([a-z]+|[+-]\d{4}))?)"
    forms = ((rf"(?i)^(?:[a-z]+,?\s+)?(\d{{1,2}})\s+([a-z]+),?\s+(\d{{4}}){clock}?$", 1, 2), (rf"(?i)^(?:[a-z]+,\s+)?([a-z]+)\s+(\d{{1,2}}),\s*(\d{{4}}){clock}?$", 2, 1), (rf"(?i)^(?:[a-z]+,\s+)?([a-z]+)\s+(\d{{1,2}})\s+(\d{{4}}){clock}$", 2, 1))
    months = {m: k + 1 for k, m in enumerate(MONTHS)} | {m[:3]: k + 1 for k, m in enumerate(MONTHS)}
    out = []
    for like, d, m in forms:
        got = lambda k, like=like: F.regexp_extract(t, like, k)
        day = _day(got(3), _lookup(months, F.lower(got(m))), got(d))
        zone = F.lower(got(5))
        numeric = F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60))
        offset = F.coalesce(numeric, _lookup(ZONES, zone) * 3600)
        parts = F.split(got(4), ":")
        seconds = sum((F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(0)) * x for k, x in enumerate((3600, 60, 1))), F.lit(0))
        # the day's midnight in UTC, moved by clock and zone, then seen from the session's zone
        moved = F.to_date(F.timestamp_seconds(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + seconds - offset))
        out.append(F.when(offset.isNotNull(), moved).otherwise(day))
    return F.coalesce(*out)


def published(text: Column, now: Column) -> Column:
    """The day of a news item as providers write it, by the first form that fits: a word or a span before now, seconds or milliseconds since
    1970, ISO, a day with the month's name, or year, month and day in digits anywhere in the text. Times with a zone are seen from
    the session's. Null for what is none of these."""
    t = F.trim(text)
    low = F.lower(t)
    word = F.when(t.isin("今天", "今日", "刚刚") | low.isin("today", "just now", "now"), F.to_date(now)).when((t == "昨天") | (low == "yesterday"), F.date_sub(F.to_date(now), 1)).when(t == "前天", F.date_sub(F.to_date(now), 2))
    span = r"^(\d{1,9})\s*(分钟|小时|天|周|个月|月|年)\s*前$"
    ago = rf"^(\d{{1,9}})\s*({'|'.join(sorted(_ENGLISH, key=len, reverse=True))})\s*ago$"
    back = F.coalesce(F.regexp_extract(t, span, 1).try_cast("long") * _lookup(_UNITS, F.regexp_extract(t, span, 2)), F.regexp_extract(low, ago, 1).try_cast("long") * _lookup(_ENGLISH, F.regexp_extract(low, ago, 2)))
    relative = F.to_date(F.timestamp_seconds(F.unix_timestamp(now) - back))
    epoch = F.to_date(F.timestamp_seconds(F.when(t.rlike(r"^(\d{10}|\d{13})$"), F.substring(t, 1, 10)).try_cast("long")))
    iso = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[^\d](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    part = lambda k: F.regexp_extract(t, iso, k)
    zone = F.regexp_replace(F.regexp_replace(part(5), "Z", "+00:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    iso_day = F.when(t.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})([^\d]|$)"), _day(part(1), F.nullif(part(2), F.lit("")), part(3)))
    zoned = F.when(zone != "", F.to_date(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), zone).try_cast("timestamp")))
    digits = r"(\d{4})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})"
    within = _day(*(F.nullif(F.regexp_extract(t, digits, k), F.lit("")) for k in (1, 2, 3)))
    return F.coalesce(word, relative, epoch, F.when(iso_day.isNotNull(), F.coalesce(zoned, iso_day)), _by_month_name(F.regexp_replace(t, r"(?i)(\d+)(st|nd|rd|th)", "$1")), within)


#: Patterns of stored times, after ISO.
STORED_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "yyyy/M/d")


def stored_time(text: Column) -> Column:
    """A timestamp without zone: ISO, or one of STORED_PATTERNS; null for what is none."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.regexp_replace(t, "T", " ")).try_cast("timestamp_ntz")
    return F.coalesce(iso, *(F.try_to_timestamp(t, F.lit(p)).cast("timestamp_ntz") for p in STORED_PATTERNS))


def list_day(text: Column) -> Column:
    """A listing day: 20010827, 2001-08-27 or 2001/8/27; null for blanks and what is none."""
    t = F.trim(text)
    return F.to_date(F.coalesce(*(F.try_to_timestamp(F.when(t.rlike(like), t), F.lit(p)) for like, p in ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d")))))


def by_keywords(df: DataFrame, keywords: Sequence[str]) -> Column:
    """The first filled value among the columns whose names hold a keyword, in the table's order."""
    some = lambda c: F.when(~F.trim(F.col(f"`{c}`").cast("string")).isin("", "-", "nan", "None"), F.col(f"`{c}`").cast("string"))
    return F.coalesce(*(some(c) for c in df.columns if any(k in c for k in keywords)), F.lit(None).cast("string"))


def dividend_per_share(plan: Column) -> Column:
    """Cash per share of a plan such as 10派3元: before tax; null without cash."""
    per_ten = F.regexp_extract(plan, r"(?:每)?10股?(?:[^派]*?)派(?:发|息)?(?:现金)?(?:红利)?(\d+(?:\.\d+)?)", 1).try_cast("double")
    per_one = F.regexp_extract(plan, r"每股(?:[^派]*?)派(?:发|息)?(?:现金)?(?:红利)?(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(per_ten / 10, per_one)


def trade_side(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(text)), " ", "")
    return F.when(t.isin("buy", "b", "买", "买入", "证券买入", "普通买入"), "buy").when(t.isin("sell", "s", "卖", "卖出", "证券卖出", "普通卖出"), "sell").when(t.contains("买入") | t.startswith("买"), "buy").when(t.contains("卖出") | t.startswith("卖"), "sell")


def dedup_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; doubles to eight digits; nulls as blanks."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def volume_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "极度萎缩").when(ratio < 0.8, "明显萎缩").when(ratio < 1.2, "正常").when(ratio < 2, "温和放量").when(ratio < 3, "明显放量").otherwise("巨量")


def ma_status(close: Column, ma5: Column, ma10: Column, ma20: Column) -> Column:
    c, a, b, d = (F.coalesce(x, F.lit(0.0)) for x in (close, ma5, ma10, ma20))
    return F.when((c > a) & (a > b) & (b > d) & (d > 0), "多头排列 📈").when((c < a) & (a < b) & (b < d) & (d > 0), "空头排列 📉").when((c > a) & (a > b), "短期向好 🔼").when((c < a) & (a < b), "短期走弱 🔽").otherwise("震荡整理 ↔️")


def sentiment(score: Column) -> Column:
    return F.when(score >= 80, "极度乐观").when(score >= 60, "乐观").when(score >= 40, "中性").when(score >= 20, "悲观").otherwise("极度悲观")


def amount_text(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").when(F.abs(x) >= 1e8, F.format_string("%.2f亿元", x / 1e8)).when(F.abs(x) >= 1e4, F.format_string("%.2f万元", x / 1e4)).otherwise(F.format_string("%.0f元", x))


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


# English words that aren't tickers, and words that say a text is about a stock.
COMMON_WORDS = """THE AND FOR ARE BUT NOT YOU ALL CAN HAD HER WAS ONE OUR OUT HAS HIS HOW ITS LET MAY NEW NOW OLD SEE WAY WHO DID GET HIM USE SAY SHE TOO ANY WITH FROM THAT THAN
THIS WHAT WHEN WILL JUST ALSO BEEN EACH HAVE MUCH ONLY OVER SOME SUCH THEM THEN THEY VERY WERE YOUR ABOUT AFTER COULD EVERY OTHER THEIR THERE THESE THOSE WHICH WOULD BEING STILL WHERE
BUY SELL HOLD LONG PUT CALL ETF IPO RSI EPS PEG ROE ROA USA USD CNY HKD EUR GBP STOCK TRADE PRICE INDEX FUND HIGH LOW OPEN CLOSE STOP LOSS TREND BULL BEAR RISK CASH BOND MACD VWAP BOLL
HELLO PLEASE THANKS CHECK LOOK THINK MAYBE GUESS TELL SHOW WHATS WHY HOWDY HEY HI""".split()
ABOUT_STOCKS = "分析|看看|查一?下|研究|诊断|走势|趋势|股价|股票|个股"
_SIX, _HK, _TICKER = r"(?<!\d)([03648]\d{5}|92\d{4})(?!\d)", r"(?i)(?<![a-zA-Z])(hk\d{5})(?!\d)", r"(?<![a-zA-Z])([A-Z]{2,5}(?:\.[A-Z]{1,2})?)(?![a-zA-Z])"


def codes_in(text: Column) -> Column:
    """Distinct six-digit A-share codes of a text, in order; digits around them disqualify."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_SIX), F.lit(1)))


def code_in(text: Column) -> Column:
    """The code that a question is about, empty for none: an A-share code, a Hong Kong one, the first word in capitals if it can be a ticker,
    the whole text if it can be one; and where the text is about a stock, the first word of it that can be one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    ticker = lambda c: F.when((c != "") & ~c.isin(COMMON_WORDS), c)
    bare = F.upper(F.regexp_extract(t, r"^([A-Za-z]{2,5}(?:\.[A-Za-z]{1,2})?)$", 1))
    words = F.transform(F.regexp_extract_all(t, F.lit(_TICKER.replace("A-Z]{2", "A-Za-z]{2").replace("A-Z]{1,2", "A-Za-z]{1,2")), F.lit(1)), F.upper)
    first = F.when(t.rlike(ABOUT_STOCKS), F.get(F.filter(words, lambda w: ~w.isin(COMMON_WORDS)), F.lit(0)))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.regexp_extract(t, _SIX, 1)), F.upper(some(F.regexp_extract(t, _HK, 1))), ticker(F.regexp_extract(t, _TICKER, 1)), ticker(bare), first, F.lit(""))


PAGE_MARK_BYTES = 16


def chunks(text: Column, most_bytes: int = 4000, page_marks: bool = False) -> Column:
    """The text cut into pieces of at most most_bytes of UTF-8, at line ends where possible and never within a letter. With page
    marks each piece ends with its number and how many there are; 16 bytes of a piece are kept for that."""

    ship(SparkSession.getActiveSession())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: None if x is None else paged(cut_bytes(x, most_bytes - PAGE_MARK_BYTES)) if page_marks else cut_bytes(x, most_bytes))

    return cut(text)


def paged(parts: list[str]) -> list[str]:
    return [f"{x}\n\n📄 {i}/{len(parts)}" for i, x in enumerate(parts, 1)]


def cut_bytes(text: str, most: int) -> list[str]:
    out, held, size = [], [], 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8")) + 1
        if held and size + n - 1 > most:
            out.append("\n".join(held))
            held, size = [], 0
        if n - 1 <= most:
            held.append(line)
            size += n
            continue
        raw, at = line.encode("utf-8"), 0
        while at < len(raw):
            end = min(len(raw), at + most)
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[at:end].decode("utf-8"))
            at = end
    if held:
        out.append("\n".join(held))
    return out or [""]


#: Names that one task holds against each other: asked for, known.
BLOCK = (8192, 32768)


def fuzzy_names(requests: DataFrame, names: DataFrame, least: float = 0.8, near: float = 0.7) -> DataFrame:
    """requests: name. names: known, code, each known once. The most similar known name at `least`, or at `near` if just one
    letter differs at equal length of 3 or more; names of up to two letters are never matched loosely.

    Every name that is asked for is held against every known one, block by block, in tasks of their own (best_matches)."""
    ship(requests.sparkSession)
    side = lambda df, name: kept(df.where(F.length(name) > 2).select(name).distinct(), "names")
    r, k = side(requests, "name"), side(names, "known")
    rows, columns = (max(1, -(-df.count() // most)) for df, most in zip((r, k), BLOCK))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = r.withColumns({"p": deal("name", rows), "q": every(columns)}).repartition(rows * columns, "p", "q")
    b = k.withColumns({"q": deal("known", columns), "p": every(rows)}).repartition(rows * columns, "p", "q")
    found = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(lambda x, y: best_matches(x["name"], y["known"], least, near), "name string, known string, ratio double")
    best = found.groupBy("name").agg(F.max_by(F.struct("known", "ratio"), F.struct("ratio", "known")).alias("m")).select("name", "m.*")
    return best.join(names, "known").select("name", "known", "code", "ratio")


def best_matches(asked: pd.Series, known: pd.Series, least: float, near: float) -> pd.DataFrame:
    """name, known, ratio: the best match among `known` of each name that has one. A similarity of `least` between names of a and b letters takes
    m = least * (a + b) / 2 letters in common, rounded up, in order. Of each name 64 bits tell which letters, numbered where they repeat, it may
    hold: most pairs lack too many of each other's and go by two operations on whole arrays. What has no m letters in common in order goes
    next, and what is left is compared as it is. So time grows with pairs, at about 3 ns each, and memory with the two blocks."""
    best: dict[str, tuple[float, str]] = {}
    rows, columns = _by_length(asked), _by_length(known)
    for (la, (xs, a, abits)), (lb, (ys, b, bbits)) in itertools.product(rows.items(), columns.items()):
        m = math.ceil(least * (la + lb) / 2 - 1e-9)
        more, less = (max(n - m, int(la == lb)) for n in (la, lb))  # letters that the other may lack; one where just one differs
        if min(more, less) < 0:
            continue
        for i, j in itertools.product(range(0, len(xs), 16), range(0, len(ys), 8192)):
            some = bbits[j : j + 8192]
            at = np.flatnonzero(np.bitwise_count(abits[i : i + 16, None] & ~some) <= more)
            x, y = i + at // len(some), j + at % len(some)
            alike = np.bitwise_count(bbits[y] & ~abits[x]) <= less
            x, y = x[alike], y[alike]
            alike = _common(a[x], b[y]) >= la - more
            for name, other in zip((xs[n] for n in x[alike]), (ys[n] for n in y[alike])):
                ratio = difflib.SequenceMatcher(None, name, other).ratio()
                if ratio >= least or (ratio >= near and la == lb and sum(p != q for p, q in zip(name, other)) == 1):
                    best[name] = max(best.get(name, (0.0, "")), (ratio, other))
    return pd.DataFrame({"name": list(best), "known": [o for _, o in best.values()], "ratio": [r for r, _ in best.values()]}).astype({"name": object, "known": object, "ratio": "float64"})


def _by_length(names: pd.Series) -> dict[int, tuple[list[str], np.ndarray, np.ndarray]]:
    """Names of each length: themselves, their letters and their bits."""
    out = {}
    for n, some in names.groupby(names.map(len)):
        letters = np.array(some.tolist(), dtype=f"<U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64)
        bits = np.zeros(len(some), np.uint64)
        for j in range(n):
            again = (letters[:, :j] == letters[:, j : j + 1]).sum(axis=1).astype(np.uint64)
            bits |= np.uint64(1) << (((letters[:, j] * np.uint64(64) + again) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        out[n] = (some.tolist(), letters, bits)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the rows of a and b have in common in order, at most: the longest common subsequence in bits of one word each (longer
    names count as alike)."""
    n = a.shape[1]
    if n > 64:
        return np.full(len(a), n)
    place, every = np.uint64(1) << np.arange(n, dtype=np.uint64), np.uint64(2**n - 1)
    left = np.full(len(a), every)
    for j in range(b.shape[1]):
        same = left & np.where(a == b[:, j : j + 1], place, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        left = ((left + same) | (left - same)) & every
    return n - np.bitwise_count(left).astype(int)
