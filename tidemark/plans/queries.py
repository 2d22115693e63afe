"""The catalogue: every operator as a query over whole tables, with its SQL for DuckDB.

Queries about retention, evolution and recovery write the table into a series of their own and call its
operations; the others take the table as a series as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import AggregateRequest, Aggregation, aggregate, aggregate_many, project, range_count, range_scan
from ..series import Series
from ..sources import tables
from ..sources.shared import new_folder
from .config import SeriesConfig, SizeModel, usable

#: The window of all range queries, in seconds.
START, END = 1704844800, 1705449600
CAPACITY, RANGE_CAPACITY, FIRST_EXTRA, BUDGET = 2500, 7000, 4000, 60_000

_EVENTS = """WITH series AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts, floor(value)::SMALLINT AS p0,
         (user_id % 1000)::SMALLINT AS p1, regexp_extract(props, '([0-9]+)', 1)::SMALLINT AS p2
  FROM events
)"""
_ORDERS = """WITH series AS (
  SELECT o_orderkey AS seq, epoch_us(o_orderdate) // 1000000 AS ts,
         floor(o_totalprice / 100)::SMALLINT AS p0, (o_custkey % 1000)::SMALLINT AS p1
  FROM orders
)"""
_RANGE = f"ts <> 0 AND ts BETWEEN {START} AND {END}"
_AGGREGATES = {
    "sum": "coalesce(((sum({c}::BIGINT)::BIGINT + 2147483648) & 4294967295) - 2147483648, 0)::INT",
    "avg": "coalesce(sum({c}::BIGINT)::BIGINT // nullif(count(*), 0), 0)::INT",
    "min": "coalesce(min({c}), 0)::INT",
    "max": "coalesce(max({c}), 0)::INT",
    "count": "count(*)::INT",
    "first": "coalesce(arg_min({c}, seq), 0)::INT",
    "last": "coalesce(arg_max({c}, seq), 0)::INT",
}
_REQUESTS = [("sum", 0), ("avg", 0), ("min", 0), ("max", 0), ("count", 0), ("first", 0), ("last", 0), ("sum", 1), ("avg", 1), ("max", 1), ("min", 2), ("last", 2)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


def _series(spark: SparkSession, rows: DataFrame, names: list[str] | None = None, capacity: int = 0) -> Series:
    """A series of its own with rows, which are numbered from 0 on, so that its own numbers are the same."""
    names = names or [c for c in rows.columns if c not in ("seq", "ts")]
    out = Series.open(spark, SeriesConfig(new_folder(spark), len(names), names, capacity))
    out.append_frame(rows, "seq")
    return out


EVER = (0, 2**32 - 1)


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir, START, END)


@_query(f"{_EVENTS} SELECT * FROM series WHERE {_RANGE}")
def range_scan_all(spark, sf_dir):
    return range_scan(_window(spark, sf_dir), START, END)


@_query(f"{_EVENTS} SELECT seq, ts, p2, p0 FROM series WHERE {_RANGE}")
def range_scan_project(spark, sf_dir):
    return range_scan(_window(spark, sf_dir), START, END, [2, 0])


@_query(f"{_EVENTS} SELECT seq, ts, p1, p1 AS p1_1 FROM series WHERE {_RANGE}")
def range_scan_repeated_column(spark, sf_dir):
    return range_scan(_window(spark, sf_dir), START, END, [1, 1])


@_query(f"{_EVENTS} SELECT seq, ts FROM series WHERE {_RANGE}")
def range_scan_timestamps_only(spark, sf_dir):
    return range_scan(_window(spark, sf_dir), START, END, [])


@_query(f"{_EVENTS} SELECT seq, ts, p0, 0::SMALLINT AS column_9 FROM series WHERE {_RANGE}")
def range_scan_bad_index(spark, sf_dir):
    return range_scan(_window(spark, sf_dir), START, END, [0, 9])


@_query(f"{_EVENTS} SELECT * FROM series WHERE ts = (SELECT max(ts) FROM series WHERE ts <= {END})")
def range_scan_point(spark, sf_dir):
    series = tables.events(spark, sf_dir)
    last = tables.events(spark, sf_dir, None, END).agg(F.max("ts").alias("ts")).scalar()
    return project(series.where((F.col("ts") == last) & (F.col("ts") != 0)))


@_query(f"{_EVENTS} SELECT * FROM series WHERE ts BETWEEN {2**32 - 2} AND {2**32 - 1}")
def range_scan_empty(spark, sf_dir):
    return range_scan(tables.events(spark, sf_dir, 2**32 - 2, 2**32 - 1), 2**32 - 2, 2**32 - 1)


@_query(f"{_ORDERS} SELECT seq, ts, p0, p1 FROM (SELECT *, max(ts) OVER (ORDER BY seq) AS top FROM series WHERE ts <> 0) WHERE ts BETWEEN 0 AND (SELECT max(ts) - 86400 FROM series) AND top <= (SELECT max(ts) - 86400 FROM series)")
def range_scan_strict_order(spark, sf_dir):
    series = tables.orders(spark, sf_dir)
    end = series.agg(F.max("ts")).first()[0]
    return range_scan(series, 0, (end or 0) - 86400, strict_order=True)


@_query(f"{_EVENTS} SELECT count(*) AS record_count FROM series WHERE {_RANGE}")
def range_count_window(spark, sf_dir):
    return range_count(_window(spark, sf_dir), START, END)


def _single(kind: str):
    return lambda spark, sf_dir: aggregate(_window(spark, sf_dir), START, END, 0, kind)


for _kind, _sql in _AGGREGATES.items():
    _query(f"{_EVENTS} SELECT {_sql.format(c='p0')} AS result FROM series WHERE {_RANGE}", f"agg_{_kind}")(_single(_kind))


def _many(df: DataFrame, start: int, end: int) -> DataFrame:
    return aggregate_many(df, start, end, [AggregateRequest(c, Aggregation(k)) for k, c in _REQUESTS])


def _many_sql(source: str, where: str) -> str:
    return f"{source} SELECT " + ", ".join(f"{_AGGREGATES[k].format(c=f'p{c}')} AS {k}_p{c}_{i}" for i, (k, c) in enumerate(_REQUESTS)) + f", count(*) AS record_count FROM series WHERE {where}"


@_query(_many_sql(_EVENTS, _RANGE))
def agg_multi(spark, sf_dir):
    return _many(_window(spark, sf_dir), START, END)


@_query(_many_sql(_EVENTS, "ts BETWEEN 4294967294 AND 4294967295"))
def agg_empty_range(spark, sf_dir):
    return _many(tables.events(spark, sf_dir, 2**32 - 2, 2**32 - 1), 2**32 - 2, 2**32 - 1)


@_query(f"{_ORDERS} SELECT " + ", ".join(f"{_AGGREGATES[k].format(c='p0')} AS {k}_p0" for k in ("first", "last")) + ", count(*) AS record_count FROM series WHERE ts <> 0")
def agg_by_arrival(spark, sf_dir):
    requests = [AggregateRequest(0, Aggregation.FIRST), AggregateRequest(0, Aggregation.LAST)]
    return aggregate_many(tables.orders(spark, sf_dir), 0, 2**32 - 1, requests, ["first_p0", "last_p0"])


@_query("""WITH series AS (SELECT l_extendedprice FROM lineitem)
SELECT ((sum(floor(l_extendedprice / 4)::BIGINT)::BIGINT * 1000 + 2147483648) & 4294967295) - 2147483648 AS result FROM series""")
def agg_sum_wrap(spark, sf_dir):
    from ..functions import wrap_int32

    return tables.read(spark, sf_dir, "lineitem").agg(wrap_int32(F.sum(F.floor(F.col("l_extendedprice") / 4)) * 1000).cast("long").alias("result"))


@_query(f"{_EVENTS} SELECT * FROM series WHERE seq >= (SELECT count(*) FROM series) - {CAPACITY} AND ts <> 0")
def ring_retention_full(spark, sf_dir):
    return _series(spark, tables.events(spark, sf_dir), capacity=CAPACITY).scan(*EVER)


@_query(f"{_EVENTS} SELECT seq, ts, p0 FROM series WHERE seq >= (SELECT count(*) FROM series) - {RANGE_CAPACITY} AND {_RANGE}")
def ring_retention_range(spark, sf_dir):
    return _series(spark, tables.events(spark, sf_dir), capacity=RANGE_CAPACITY).scan(START, END, [0])


@_query(f"{_EVENTS} SELECT * FROM series WHERE ts <> 0")
def ring_unlimited(spark, sf_dir):
    return _series(spark, tables.events(spark, sf_dir)).scan(*EVER)


def _with_extras(spark, sf_dir) -> Series:
    """Two base columns, and p2 as an extra that only rows from FIRST_EXTRA on have."""
    rows = tables.events(spark, sf_dir)
    out = _series(spark, rows.where(F.col("seq") < FIRST_EXTRA), ["p0", "p1"])
    out.add_extras(["p2"])
    out.append_frame(rows.where(F.col("seq") >= FIRST_EXTRA), "seq")
    return out


_EXTRAS = _EVENTS.replace("FROM events\n)", f"FROM events\n), extras AS (SELECT seq, ts, p0, p1, (CASE WHEN seq >= {FIRST_EXTRA} THEN p2 ELSE 0 END)::SMALLINT AS p2 FROM series)")


@_query(f"{_EXTRAS} SELECT * FROM extras WHERE ts <> 0")
def extras_backfill_scan(spark, sf_dir):
    return _with_extras(spark, sf_dir).scan(*EVER)


@_query(f"{_EXTRAS} SELECT " + ", ".join(f"{_AGGREGATES[k].format(c='p2')} AS {k}_p2" for k in ("min", "avg", "sum", "first", "last")) + ", count(*) AS record_count FROM extras WHERE ts <> 0")
def extras_backfill_agg(spark, sf_dir):
    kinds = ("min", "avg", "sum", "first", "last")
    return aggregate_many(_with_extras(spark, sf_dir).frame(), *EVER, [AggregateRequest(2, Aggregation(k)) for k in kinds], [f"{k}_p2" for k in kinds])


@_query(f"{_EXTRAS} SELECT seq, ts, p0, p1, 0::SMALLINT AS x_new, p2 FROM extras WHERE ts <> 0")
def extras_migrate(spark, sf_dir):
    series = _with_extras(spark, sf_dir)
    series.migrate_extras(["x_new", "p2"])
    return series.scan(*EVER)


@_query(f"{_EXTRAS} SELECT seq, ts, p2, p0, 0::SMALLINT AS site FROM extras WHERE ts <> 0")
def schema_migrate_project(spark, sf_dir):
    series = _with_extras(spark, sf_dir)
    series.migrate_schema(["p2", "p0", "site"])
    return series.scan(*EVER)


_FIT = SizeModel(3, 0, 380).fit(usable(BUDGET))


@_query(f"{_EVENTS} SELECT seq - (SELECT count(*) FROM series) + least((SELECT count(*) FROM series), {_FIT}) AS seq, ts, p0, p1, p2 FROM series WHERE seq >= (SELECT count(*) FROM series) - {_FIT}")
def schema_migrate_trim(spark, sf_dir):
    series = _series(spark, tables.events(spark, sf_dir), ["p2", "p1", "p0"])
    series.migrate_schema(["p0", "p1", "p2"], free_space_bytes=BUDGET, allow_trim=True)
    return series.frame()


@_query(f"{_EVENTS} SELECT seq, ts, p0, p1, p2 FROM series WHERE seq >= (SELECT count(*) FROM series) - 25")
def resize_shrink_newest(spark, sf_dir):
    series = _series(spark, tables.events(spark, sf_dir))
    before = series.stats().first().total_records
    series.resize(25)
    return series.frame().withColumn("seq", F.col("seq") + max(0, before - 25))  # a resized series counts from its first row


@_query(f"""{_EVENTS} SELECT least(count(*), {CAPACITY}) AS total_records, {CAPACITY}::BIGINT AS max_records,
  arg_min(ts, seq) FILTER (seq >= (SELECT count(*) FROM series) - {CAPACITY}) AS oldest_timestamp, arg_max(ts, seq) AS newest_timestamp,
  count(*) AS total_writes, greatest(count(*) - {CAPACITY}, 0) AS total_evictions FROM series""")
def stats(spark, sf_dir):
    series = _series(spark, tables.events(spark, sf_dir), capacity=CAPACITY)
    return series.stats().select("total_records", "max_records", "oldest_timestamp", "newest_timestamp", "total_writes", "total_evictions")


@_query(f"{_ORDERS} SELECT count(*) AS total_records, min(ts) AS min_ts, max(ts) AS max_ts, arg_min(ts, seq) AS oldest_timestamp, arg_max(ts, seq) AS newest_timestamp, min(seq) AS first_seq, max(seq) AS last_seq FROM series WHERE ts <> 0")
def header_rebuild(spark, sf_dir):
    """The series loses its manifests and is opened again."""
    lost = _series(spark, tables.orders(spark, sf_dir))
    lost.store.forget()
    rows = Series.open(spark, lost.config).frame()
    return rows.agg(F.count(F.lit(1)).alias("total_records"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min_by("ts", "seq").alias("oldest_timestamp"), F.max_by("ts", "seq").alias("newest_timestamp"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@_query(f"{_EVENTS} SELECT '{{\"ts\":' || ts || ',\"p0\":' || p0 || ',\"p1\":' || p1 || ',\"p2\":' || p2 || '}}' AS json FROM series WHERE {_RANGE}")
def rows_as_json(spark, sf_dir):
    return _series(spark, tables.events(spark, sf_dir)).query(START, END).to_json()
