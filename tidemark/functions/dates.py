"""Date parsing and calendar expressions.

Day-first parsing (C1) uses an explicit list of formats instead of format
inference: ISO stays ISO, day-first strings are read day-first, and a value
no format accepts becomes NULL (and is counted as rejected by the caller).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tidemark.functions.numeric import col_of

# Accepted input formats, tried in this order.
DAY_FIRST_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d/M/yy",
)

MICROS_PER_DAY = 86_400_000_000


def format_shape(pattern: str) -> str:
    """A regular expression that every text the format accepts matches:
    signed numbers of as many digits as letters or more, with the format's
    other characters between them."""
    def part(m: re.Match) -> str:
        if m["field"]:
            return rf"[+-]?\d{{{len(m['field'])},}}"
        return "".join(f"[{x.upper()}{x.lower()}]" if x.isalpha() else re.escape(x) for x in m["quoted"] or m["other"])
    return "^" + re.sub(r"'(?P<quoted>[^']+)'|(?P<field>([A-Za-z])\3*)|(?P<other>.)", part, pattern) + "$"


def parse_day_first(c, formats=DAY_FIRST_FORMATS) -> Column:
    """String column -> timestamp; NULL when no format accepts the value.

    A format is tried only on texts of its shape: each refusal of a parser
    is an exception, which costs many times what the parsing does."""
    s = F.trim(col_of(c).cast("string"))
    return F.coalesce(*[F.when(s.rlike(format_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in formats])


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Typed date columns pass through; strings are parsed day-first."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.col(name)
    if isinstance(dtype, DateType):
        return F.col(name).cast("timestamp")
    return parse_day_first(name)


def month_start(c) -> Column:
    """Calendar-month bucket (C3) as a DATE."""
    return F.trunc(F.to_date(col_of(c)), "month")


def month_label(c) -> Column:
    """YYYY-MM label (C4)."""
    return F.date_format(col_of(c), "yyyy-MM")


def lead_days(order_ts, ship_ts) -> Column:
    """Whole days from order to shipment, floored (C5, SN6): -23 h -> -1."""
    micros = F.timestamp_diff("MICROSECOND", col_of(order_ts), col_of(ship_ts))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("long")
