"""Stock codes: normal forms, markets and boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of US indexes, prefixes of exchanges, boards and funds, and words of fund names.
US_INDEXES = ("SPX", "^GSPC", "GSPC", "DJI", "^DJI", "DJIA", "IXIC", "^IXIC", "NASDAQ", "NDX", "^NDX", "VIX", "^VIX", "RUT", "^RUT")
SSE = ("600", "601", "603", "605")
SZSE = ("000", "001", "002", "003", "300")
BSE = ("430", "83", "87", "92")
ETF = ("51", "52", "56", "58", "15", "16", "18")
FUND_WORDS = ("ETF", "FUND", "TRUST", "INDEX", "TRACKER", "UNIT")
_TICKER = r"^[A-Z]{1,5}(\.[A-Z])?$"


def _begins(code: Column, prefixes: tuple[str, ...]) -> Column:
    return code.rlike("^(" + "|".join(prefixes) + ")")


def canonical(code: Column) -> Column:
    return F.upper(F.trim(F.coalesce(code, F.lit(""))))


def normalize(code: Column) -> Column:
    """Exchange prefixes and suffixes go; Hong Kong codes become HK and five digits; what fits no rule stays as it is written."""
    c = canonical(code)
    hk = lambda digits: F.concat(F.lit("HK"), F.lpad(digits, 5, "0"))
    return (
        F.when(c.rlike(r"^HK\d{1,5}$"), hk(F.substring(c, 3, 10)))
        .when(c.rlike(r"^(SH|SZ)\d{5,6}$") | c.rlike(r"^BJ\d{6}$"), F.substring(c, 3, 10))
        .when(c.rlike(r"^\d{1,5}\.HK$"), hk(F.regexp_extract(c, r"^(\d+)", 1)))
        .when(c.rlike(r"^\d+\.(SH|SZ|SS|BJ)$"), F.regexp_extract(c, r"^(\d+)", 1))
        .otherwise(F.trim(F.coalesce(code, F.lit(""))))
    )


def import_code(code: Column) -> Column:
    """The form of imported lists, null for what is no code: here a Hong Kong prefix goes, too."""
    c = canonical(code)
    return (
        F.when(c.rlike(r"^\d{5,6}$") | c.rlike(_TICKER), c)
        .when(c.rlike(r"^\d{5,6}\s*\.(SH|SZ|SS)$"), F.regexp_extract(c, r"^(\d+)", 1))
        .when(c.rlike(r"^(SH|SZ|SS)\d{6}$") | c.rlike(r"^HK\d{5}$"), F.substring(c, 3, 10))
    )


def is_us_index(code: Column) -> Column:
    return canonical(code).isin(*US_INDEXES)


def is_hk(code: Column) -> Column:
    return canonical(code).rlike(r"^(HK\d{1,5}|\d{1,5}\.HK|\d{5})$")


def market(code: Column) -> Column:
    """Indexes are told apart, as quotes of theirs have a source of their own; what is neither us nor hk is cn."""
    return F.when(is_us_index(code), "us-index").otherwise(market_tag(code))


def market_tag(code: Column) -> Column:
    return F.when(is_us_index(code) | canonical(code).rlike(_TICKER), "us").when(is_hk(code), "hk").otherwise("cn")


def exchange(code: Column) -> Column:
    return F.when(_begins(code, SSE), "SSE").when(_begins(code, SZSE), "SZSE").when(_begins(code, BSE), "BSE").otherwise("CN")


def _stem(code: Column) -> Column:
    return F.substring_index(F.trim(F.coalesce(code, F.lit(""))), ".", 1)


def is_bse(code: Column) -> Column:
    """Six digits from 4, 8 or 92; 900xxx are Shanghai's B shares."""
    return _stem(code).rlike(r"^([48]\d|92)\d{4}$")


def is_growth_board(code: Column) -> Column:
    return _begins(_stem(code), ("688", "30"))


def is_etf(code: Column) -> Column:
    n = normalize(code)
    return n.rlike(r"^\d{6}$") & _begins(n, ETF)


def is_st(name: Column) -> Column:
    return F.coalesce(F.upper(name).contains("ST"), F.lit(False))


def is_foreign(code: Column) -> Column:
    """Searched for in English: tickers, anything that begins with hk, five digits."""
    return canonical(code).rlike(r"^([A-Z]{1,5}(\.[A-Z])?|HK.*|\d{5})$")


def is_index_or_fund(code: Column, name: Column) -> Column:
    stem = _stem(code)
    fund = F.upper(F.coalesce(name, F.lit(""))).rlike("|".join(FUND_WORDS))
    return (stem != "") & ((stem.rlike(r"^\d{6}$") & _begins(stem, ETF)) | is_us_index(stem) | (is_foreign(stem) & fund))
