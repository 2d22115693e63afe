"""Every query of the engine against DuckDB, and the plans that large inputs rely on."""

import glob
import os

import duckdb
import pytest

from tidemark.operators import range_scan
from tidemark.plans.queries import END, QUERIES, SQL, START
from tidemark.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda found, names: sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in found)))
    assert rows(map(tuple, ours.collect()), ours.columns) == rows(theirs.fetchall(), theirs.columns)


def explain(spark, df):
    return df._jdf.queryExecution().toString()


def test_range_and_columns_reach_the_scan(spark):
    plan = explain(spark, range_scan(tables.events(spark, DATA, START, END), START, END, [0]))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan


def test_stored_series_prunes_segments_and_columns(spark, tmp_path):
    from tidemark.plans.config import SeriesConfig
    from tidemark.series import Series

    s = Series.open(spark, SeriesConfig(str(tmp_path / "s"), 3))
    for k in range(3):
        s.append_batch([100 * k + i for i in range(1, 11)], [[i, i, i] for i in range(10)])
    df = s.scan(101, 105, [1])
    assert len(df.inputFiles()) == len(s._store.rows(s._manifest, 101, 105).inputFiles()) < len(s.frame().inputFiles())
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = explain(spark, s.scan(101, 105, [1]))
    assert "ReadSchema: struct<seq:bigint,ts:bigint,c1:smallint>" in plan and "GreaterThanOrEqual(ts,101)" in plan


def test_one_pass_for_many_aggregates(spark):
    plan = QUERIES["agg_multi"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan and plan.count("Exchange") == 1
