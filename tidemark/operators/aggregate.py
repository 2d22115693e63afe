"""Aggregates over a time range: many requests in one pass, exact 32-bit results."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import truncated_average, wrap_int32
from .scan import checked_range, value_columns


class Aggregation(Enum):
    SUM = "sum"
    AVG = "avg"
    MIN = "min"
    MAX = "max"
    COUNT = "count"
    FIRST = "first"
    LAST = "last"


@dataclass(frozen=True)
class AggregateRequest:
    """An aggregation of the column at a place."""

    column: int
    kind: Aggregation


def expression(name: str, kind: Aggregation | str) -> Column:
    """The aggregate of a column, as a 32-bit number, 0 over no rows.

    FIRST and LAST go by arrival (seq), whatever the timestamps; COUNT counts rows, whatever the column.
    """
    value, kind = F.col(f"`{name}`"), Aggregation(kind)
    if kind is Aggregation.SUM:
        return wrap_int32(F.sum(value.cast("long")))
    if kind is Aggregation.AVG:
        return truncated_average(F.sum(value.cast("long")), F.count(F.lit(1)))
    if kind is Aggregation.COUNT:
        return wrap_int32(F.count(F.lit(1)))
    of = {Aggregation.MIN: F.min(value), Aggregation.MAX: F.max(value), Aggregation.FIRST: F.min_by(value, "seq"), Aggregation.LAST: F.max_by(value, "seq")}[kind]
    return F.coalesce(of.cast("int"), F.lit(0))


def aggregate_many(df: DataFrame, start: int, end: int, requests: list[AggregateRequest], names: list[str] | None = None) -> DataFrame:
    """One row: a column for each request, then record_count.

    Columns are named by names, else by kind and column. Only columns that are asked for are read.
    """
    checked_range(start, end)
    columns = value_columns(df)
    out = []
    for k, r in enumerate(requests):
        if not 0 <= r.column < len(columns):
            raise ValueError(f"no column at place {r.column}")
        out.append(expression(columns[r.column], r.kind).alias(names[k] if names else f"{Aggregation(r.kind).value}_{columns[r.column]}_{k}"))
    rows = df.where((F.col("ts") != 0) & (F.col("ts") >= start) & (F.col("ts") <= end))
    return rows.agg(*out, F.count(F.lit(1)).alias("record_count"))


def aggregate(df: DataFrame, start: int, end: int, column: int, kind: Aggregation | str) -> DataFrame:
    """One row with one column, result."""
    return aggregate_many(df, start, end, [AggregateRequest(column, Aggregation(kind))], ["result"]).select("result")
