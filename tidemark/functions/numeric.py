"""Column expressions for arithmetic and rounding.

All of them are built-in Spark expressions, so they stay inside
whole-stage codegen.

Rounding rule: sums computed on a cluster are added in an order that
changes from run to run, so the last bits of a double sum vary. Money is
therefore added as decimals of the data's native scale (4 decimals: cents
times a two-decimal discount) with ``total``: the sum is exact whatever the
order and the size. Displayed values are then rounded half-up as decimals
(``money``), so the shown digits are also order-independent. Averages of
k snapped values are exact at a few more decimals (``native`` argument).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NATIVE_SCALE = 4


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Amounts as decimals: 24 digits before the point, and sums of 34.
MONEY_TYPE = f"decimal(28,{NATIVE_SCALE})"


def exact_total(c) -> Column:
    """Exact decimal sum of amounts; NaN and infinite amounts are left out."""
    return F.sum(col_of(c).try_cast(MONEY_TYPE))


def total(c) -> Column:
    """``exact_total`` as the nearest double."""
    return exact_total(c).cast("double")


def total_sql(expr: str) -> str:
    """The same rule as ``total`` in SQL (used by the oracle queries)."""
    return f"CAST(SUM(TRY_CAST({expr} AS {MONEY_TYPE.upper()})) AS DOUBLE)"


def money(c, scale: int = 2, native: int = NATIVE_SCALE) -> Column:
    """Order-independent half-up rounding of an amount to ``scale`` decimals."""
    snapped = F.round(col_of(c), native).cast(f"decimal(38,{native})")
    return F.round(snapped, scale).cast("double")


def money_sql(expr: str, scale: int = 2, native: int = NATIVE_SCALE) -> str:
    """The same rule as ``money`` in ANSI SQL (used by the oracle queries)."""
    return (f"CAST(ROUND(CAST(ROUND({expr}, {native}) AS DECIMAL(38,{native})), "
            f"{scale}) AS DOUBLE)")


def ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col_of(num), col_of(den))


def pct(num, den) -> Column:
    return ratio(num, den) * F.lit(100.0)


def no_neg_zero(c) -> Column:
    """-0.0 becomes 0.0 (parquet data holds negative zeros)."""
    return col_of(c) + F.lit(0.0)


GUARD_DIGITS = 6


def rnd(c, scale: int) -> Column:
    """Half-up rounding through a decimal with ``GUARD_DIGITS`` extra digits.

    Spark's and DuckDB's ``round`` on doubles disagree on values such as
    0.145 (one rounds the shortest decimal form, the other the binary
    value); going through the decimal makes both round the decimal form."""
    return F.round(col_of(c).cast(f"decimal(38,{scale + GUARD_DIGITS})"), scale).cast("double")


def rnd_sql(expr: str, scale: int) -> str:
    return (f"CAST(ROUND(CAST({expr} AS DECIMAL(38,{scale + GUARD_DIGITS})), {scale}) "
            f"AS DOUBLE)")
