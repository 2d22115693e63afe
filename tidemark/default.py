"""One default series for programs that need no more, with functions instead of a handle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import AggregateRequest, Aggregation
from .plans.config import SeriesConfig, SeriesStateError
from .series import Query, Series

_series: Series | None = None


def init(spark: SparkSession, config: SeriesConfig) -> None:
    """Open the default series; one that is open already stays."""
    global _series
    if not is_initialized():
        _series = Series.open(spark, config)


def current() -> Series:
    if _series is None or not _series.is_open:
        raise SeriesStateError("no default series is open")
    return _series


def is_initialized() -> bool:
    return _series is not None and _series.is_open


def close() -> None:
    if _series is not None:
        _series.close()


def write(ts: int, values: Sequence[int]) -> None:
    current().append(ts, values)


def write_batch(timestamps: Sequence[int], values: Sequence[Sequence[int]]) -> None:
    current().append_batch(timestamps, values)


def query(start: int, end: int, columns: list[int] | None = None) -> Query:
    return current().query(start, end, columns)


def query_count(start: int, end: int) -> int:
    return current().count(start, end)


def aggregate(start: int, end: int, column: int, kind: Aggregation | str) -> int:
    return current().aggregate(start, end, column, kind)


def aggregate_multi(start: int, end: int, requests: list[AggregateRequest]) -> tuple[list[int], int]:
    return current().aggregate_many(start, end, requests)


def get_stats() -> DataFrame:
    return current().stats()


def clear() -> None:
    current().clear()


def delete() -> None:
    current().delete()


def sync() -> None:
    current().sync()


def add_extra_params(names: list[str]) -> None:
    current().add_extras(names)


def migrate_overflow(names: list[str]) -> None:
    current().migrate_extras(names)


def migrate_schema(names: list[str], **options) -> None:
    current().migrate_schema(names, **options)


def resize(max_records: int, **options) -> None:
    current().resize(max_records, **options)


def get_total_params() -> int:
    return _series.total_columns if _series is not None else 0


def get_param_name(place: int) -> str | None:
    return current().column_name(place)


def has_overflow() -> bool:
    return _series is not None and _series.has_extras
