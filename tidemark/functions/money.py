"""Money arithmetic on the snapped decimal value (see ``numeric.money``)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import NATIVE_SCALE, col_of


def snapped(c) -> Column:
    return F.round(col_of(c), NATIVE_SCALE).cast(f"decimal(38,{NATIVE_SCALE})")


def money_times(c, factor: float, scale: int = 2) -> Column:
    """round(c * factor, scale) of the snapped value in exact decimal arithmetic."""
    f = Decimal(repr(factor))
    return F.round(snapped(c) * F.lit(f), scale).cast("double")


def money_times_sql(expr: str, factor: float, scale: int = 2) -> str:
    f = Decimal(repr(factor))
    digits = max(1, len(f.as_tuple().digits))
    exp = max(0, -f.as_tuple().exponent)
    return (f"CAST(ROUND(CAST(ROUND({expr}, {NATIVE_SCALE}) AS DECIMAL(38,{NATIVE_SCALE})) "
            f"* CAST({f} AS DECIMAL({max(digits, exp + 1)},{exp})), {scale}) AS DOUBLE)")
