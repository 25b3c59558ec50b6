"""Exchange-local dates and times over UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions.numbers import as_col, literal_lookup

EXCHANGE_ZONE = "Asia/Kolkata"
MARKET_OPEN = "09:15"

# Month abbreviations of exchange dates.
MONTH_NUMBER = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

_DATE_TEXT = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


def parse_exchange_time(c: Column | str) -> Column:
    """``5-Jan-2024[ 10:15[:00]]`` in exchange time to a UTC instant; NULL when malformed."""
    text = F.trim(as_col(c))
    part = lambda i: F.regexp_extract(text, _DATE_TEXT, i)
    clock = lambda i: F.lpad(F.when(part(i) == "", "0").otherwise(part(i)), 2, "0")
    month = literal_lookup(F.lower(part(2)), MONTH_NUMBER)
    stamp = F.concat(
        part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "),
        clock(4), F.lit(":"), clock(5), F.lit(":"), clock(6),
    )
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(text.rlike(_DATE_TEXT), F.to_utc_timestamp(local, EXCHANGE_ZONE))


def exchange_date(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(as_col(ts), EXCHANGE_ZONE))


def exchange_clock(ts: Column | str) -> Column:
    return F.date_format(F.from_utc_timestamp(as_col(ts), EXCHANGE_ZONE), "HH:mm")


def tradeable_after(ts: Column | str, market_open: str = MARKET_OPEN) -> Column:
    """Last date whose session is already gone when the news arrives.

    News before the open leaves the same day's session usable, so it maps to the day before.
    """
    day = exchange_date(ts)
    return F.when(exchange_clock(ts) < market_open, F.date_sub(day, 1)).otherwise(day)


def days_to_expiry(expiry: Column, trade_date: Column) -> Column:
    return F.datediff(expiry, trade_date)


def year_fraction(expiry: Column, trade_date: Column) -> Column:
    return F.datediff(expiry, trade_date) / F.lit(365.0)
