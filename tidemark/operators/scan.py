"""Inclusive time-range scans with positional projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST_SEQ = 2**63 - 1


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("seq", "ts")]


def checked_range(start: int, end: int) -> None:
    if start > end:
        raise ValueError(f"start {start} is after end {end}")


def project(df: DataFrame, indices: list[int] | None = None, limit: int = 64) -> DataFrame:
    """seq, ts and the columns at the given places, in that order; all columns for None.

    A place that names no column gives zeros. A place may come again; later ones are named with their
    rank. An empty list leaves the timestamps.
    """
    names = value_columns(df)
    if indices is None:
        return df.select("seq", "ts", *[F.col(f"`{n}`") for n in names])
    if len(indices) > limit:
        raise ValueError(f"at most {limit} columns can be asked for")
    out, used = [], set()
    for rank, i in enumerate(indices):
        known = 0 <= i < len(names)
        name = names[i] if known else f"column_{i}"
        if name in used:
            name = f"{name}_{rank}"
        used.add(name)
        out.append((F.col(f"`{names[i]}`") if known else F.lit(0).cast("short")).alias(name))
    return df.select("seq", "ts", *out)


def range_scan(df: DataFrame, start: int, end: int, indices: list[int] | None = None, *, strict_order: bool = False) -> DataFrame:
    """Rows with start <= ts <= end and a timestamp other than 0, projected; arrival order is seq.

    strict_order stops at the first row in arrival order that lies beyond end, as a reader would that
    takes timestamps for ascending; later rows in the range are lost then. The place is found by one
    aggregate, not by a window over all rows.
    """
    checked_range(start, end)
    rows = df.where(F.col("ts") != 0)
    found = rows.where((F.col("ts") >= start) & (F.col("ts") <= end))
    if strict_order:
        stop = rows.where(F.col("ts") > end).agg(F.coalesce(F.min("seq"), F.lit(LAST_SEQ)).alias("stop")).scalar()
        found = found.where(F.col("seq") < stop)
    return project(found, indices)


def range_count(df: DataFrame, start: int, end: int) -> DataFrame:
    """One row: record_count in the range; only ts is read."""
    checked_range(start, end)
    return df.where((F.col("ts") != 0) & (F.col("ts") >= start) & (F.col("ts") <= end)).agg(F.count(F.lit(1)).alias("record_count"))
