"""Integer rules that ANSI casts do not give: wrapping, truncating division, zero for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_int32(value: Column) -> Column:
    """A 64-bit number reduced modulo 2**32 to the signed 32-bit range; null as 0."""
    value = F.coalesce(value, F.lit(0).cast("long"))
    return ((value + F.lit(2147483648)).bitwiseAND(F.lit(4294967295)) - F.lit(2147483648)).cast("int")


def truncated_average(total: Column, count: Column) -> Column:
    """total / count without its fraction, toward zero; 0 for no rows."""
    return wrap_int32(F.call_function("div", total, F.nullif(count, F.lit(0).cast("long"))))


def zero_filled(value: Column) -> Column:
    """A 16-bit value, 0 where a row has none."""
    return F.coalesce(value, F.lit(0).cast("short")).cast("short")
