"""Series views of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def between_seconds(df: DataFrame, ts: str, start: int | None, end: int | None) -> DataFrame:
    """Rows whose whole second is in start to end, by the raw column, so that the scan can skip row groups."""
    at = lambda s: F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, {s})")
    if start is not None:
        df = df.where(F.col(ts) >= at(start))
    if end is not None:
        df = df.where(F.col(ts) < at(end + 1))
    return df


def series(df: DataFrame, seq: Column, ts: Column, values: dict[str, Column]) -> DataFrame:
    """seq, ts and 16-bit value columns, as every operator here takes them."""
    return df.select(seq.cast("long").alias("seq"), ts.cast("long").alias("ts"), *[v.cast("short").alias(n) for n, v in values.items()])


def events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A series in time order; start and end (seconds, inclusive) reach the scan."""
    df = between_seconds(read(spark, sf_dir, "events"), "ts", start, end)
    return series(df, F.col("event_id"), seconds("ts"), {"p0": F.floor("value"), "p1": F.col("user_id") % 1000, "p2": F.regexp_extract("props", "([0-9]+)", 1)})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series that is not in time order, with many equal timestamps."""
    df = read(spark, sf_dir, "orders")
    return series(df, F.col("o_orderkey"), seconds("o_orderdate"), {"p0": F.floor(F.col("o_totalprice") / 100), "p1": F.col("o_custkey") % 1000})
