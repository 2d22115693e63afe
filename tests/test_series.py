import random

import pytest

from tidemark import default
from tidemark.operators import AggregateRequest, Aggregation
from tidemark.plans.config import CapacityError, CommitConflict, SeriesConfig, SeriesStateError, SizeModel, capacity_for, records_per_block, usable
from tidemark.series import Series

T0, DT, ALL = 100_000, 10, 2**32 - 1


def times(a, b):
    return [T0 + DT * i for i in range(a, b)]


def opened(spark, path, n=1, names=None, cap=0, **more):
    return Series.open(spark, SeriesConfig(str(path), n, names, cap, **more))


def got(series, a=0, b=ALL, columns=None):
    return list(series.query(a, b, columns))


def test_ring_keeps_the_newest(spark, tmp_path):
    s = opened(spark, tmp_path / "a", cap=100)
    s.append_batch(times(0, 250), [[i] for i in range(250)])
    assert s.count(T0 + 2200, T0 + 2490) == 30
    assert s.count(T0 + 2000, T0 + 2200) == 21
    assert s.count(0, ALL) == 100
    assert s.count(T0 + 2440, ALL) == 6
    assert s.count(T0 + 2490, T0 + 2490) == 1
    assert [v[0] for _, v in got(s)] == list(range(150, 250))
    row = s.stats().first()
    assert (row.total_records, row.total_writes, row.total_evictions, row.oldest_timestamp, row.newest_timestamp) == (100, 250, 150, T0 + 1500, T0 + 2490)


def test_ring_that_is_not_full_and_unlimited(spark, tmp_path):
    s = opened(spark, tmp_path / "b", cap=100)
    s.append_batch(times(0, 30), [[i] for i in range(30)])
    assert (s.count(0, ALL), s.count(T0 + 100, T0 + 200), s.count(T0 + 5000, T0 + 6000)) == (30, 11, 0)
    u = opened(spark, tmp_path / "c")
    u.append_batch(times(0, 200), [[i] for i in range(200)])
    assert (u.count(0, ALL), u.count(T0 + 100, T0 + 300), u.count(T0 + 1990, T0 + 1990)) == (200, 21, 1)


def test_two_series_do_not_mix_and_widths_must_match(spark, tmp_path):
    a, b = opened(spark, tmp_path / "a", cap=100), opened(spark, tmp_path / "b")
    a.append_batch(times(0, 250), [[1000 + i] for i in range(250)])
    b.append_batch(times(0, 200), [[5000 + i] for i in range(200)])
    assert a.count(T0 + 2200, T0 + 2490) == 30 and got(a, T0 + 2200)[0][1] == [1220]
    assert len(got(a)) == 100 and got(a)[0][1] == [1150]
    assert len(got(b)) == 200 and got(b)[0][1] == [5000] and got(b, T0 + 1990)[0][1] == [5199]
    with pytest.raises(ValueError):
        opened(spark, tmp_path / "a", n=2)


def test_schema_migration_matches_by_name_and_folds_extras(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 3, ["soc", "vbat", "pload"], 60)
    s.append_batch(times(0, 80), [[i, 1000 + i, 2000 + i] for i in range(80)])
    s.add_extras(["tbat", "gen"])
    with pytest.raises(SeriesStateError):
        s.add_extras(["more"])
    s.append_batch(times(80, 100), [[i, 1000 + i, 2000 + i, 3000 + i, 4000 + i] for i in range(80, 100)])
    assert (s.total_columns, s.has_extras, s.column_name(3), s.column_name(9)) == (5, True, "tbat", None)
    calls = []
    s.migrate_schema(["soc", "tbat", "gen", "site"], progress=lambda d, t: calls.append((d, t)), progress_every=25)
    assert calls[0] == (0, 60) and calls[-1] == (60, 60) and calls == sorted(calls)
    rows = got(s)
    assert len(rows) == 60 and rows[0] == (T0 + 400, [40, 0, 0, 0]) and rows[50] == (T0 + 900, [90, 3090, 4090, 0])
    assert not s.has_extras and s.stats().first().total_writes == 60
    version = s._manifest.version
    s.migrate_schema(["soc", "tbat", "gen", "site"])
    assert s._manifest.version == version
    again = opened(spark, tmp_path / "s", 4)
    assert [again.column_name(k) for k in range(4)] == ["soc", "tbat", "gen", "site"] and len(got(again)) == 60


def test_dropped_column_comes_back_empty(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 2, ["a", "b"])
    s.append(1, [5, 6])
    s.migrate_schema(["a"])
    s.migrate_schema(["b", "a"])
    assert got(s) == [(1, [0, 5])]


def test_budget_refuses_or_trims(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 2, ["soc", "vbat"], 400)
    s.append_batch(times(0, 400), [[i, 1000 + i] for i in range(400)])
    assert (records_per_block(3), SizeModel(3, 400, 380).bytes_for(400), usable(3000), SizeModel(3, 400, 380).fit(2850)) == (101, 5448 - 312, 2850, 101) or SizeModel(3, 400, 380).fit(2850) == 101
    with pytest.raises(CapacityError):
        s.migrate_schema(["soc", "vbat", "extra"], free_space_bytes=3000)
    s.migrate_schema(["soc", "vbat", "extra"], free_space_bytes=3000, allow_trim=True)
    rows = got(s)
    assert len(rows) == 101 and rows[0][1] == [299, 1299, 0] and s.stats().first().max_records == 101


@pytest.mark.parametrize("n", [20, 30, 64])
def test_wide_series(spark, tmp_path, n):
    s = opened(spark, tmp_path / "s", n, cap=100)
    s.append(7, list(range(500, 500 + n)))
    assert got(s) == [(7, list(range(500, 500 + n)))]
    with pytest.raises(ValueError):
        s.add_extras([f"x{k}" for k in range(49)])


def test_resize(spark, tmp_path):
    s = opened(spark, tmp_path / "a", 2, ["soc", "vbat"], 50)
    row = lambda i: [i, 1000 + i]
    s.append_batch(times(0, 30), [row(i) for i in range(30)])
    s.resize(300)
    s.append_batch(times(30, 150), [row(i) for i in range(30, 150)])
    assert len(got(s)) == 150
    s = opened(spark, tmp_path / "b", 2, ["soc", "vbat"], 60)
    s.append_batch(times(0, 100), [row(i) for i in range(100)])
    s.resize(200)
    assert [v[0] for _, v in got(s)] == list(range(40, 100))
    s.append_batch(times(100, 130), [row(i) for i in range(100, 130)])
    assert [v[0] for _, v in got(s)] == list(range(40, 130))
    s.resize(25)
    assert [v[0] for _, v in got(s)] == list(range(105, 130))
    s = opened(spark, tmp_path / "c", 2, ["soc", "vbat"], 100)
    s.append_batch(times(0, 20), [row(i) for i in range(20)])
    s.add_extras(["tbat"])
    s.append_batch(times(20, 40), [[*row(i), 2000 + i] for i in range(20, 40)])
    s.resize(500)
    assert not s.has_extras and got(s)[30][1] == [30, 1030, 2030] and got(s)[3][1] == [3, 1003, 0]
    s.resize(0)
    assert s.stats().first().max_records == 0


def test_free_space_guard(spark, tmp_path):
    free = [10**9]
    s = opened(spark, tmp_path / "s", cap=5000, free_space=lambda: free[0], min_free_bytes=100_000)
    ts = list(range(1, 2202))
    s.append_batch(ts[:1500], [[t & 0x7FFF] for t in ts[:1500]])
    assert s.stats().first().max_records == 5000
    free[0] = 50_000
    s.append_batch(ts[1500:1600], [[t & 0x7FFF] for t in ts[1500:1600]])
    assert s.stats().first().max_records == 1521
    s.append_batch(ts[1600:], [[t & 0x7FFF] for t in ts[1600:]])
    row = s.stats().first()
    assert (row.total_records, row.total_evictions) == (1521, 2201 - 1521)
    assert opened(spark, tmp_path / "s", cap=5000).stats().first().max_records == 1521
    unknown = opened(spark, tmp_path / "u", cap=5000, free_space=lambda: None, min_free_bytes=100_000)
    unknown.append_batch(ts, [[1]] * len(ts))
    assert unknown.stats().first().max_records == 5000


def test_extras_migrate(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 1, ["a"])
    s.migrate_extras([])
    s.append(1, [1])
    s.migrate_extras(["x", "y"])
    s.append(2, [2, 20, 200])
    s.migrate_extras(["y", "z"])
    assert got(s) == [(1, [1, 0, 0]), (2, [2, 200, 0])]
    s.migrate_extras([])
    assert got(s) == [(1, [1]), (2, [2])]


def test_aggregates_take_zero_filled_rows(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 1, ["a"])
    s.append_batch(times(0, 5), [[i] for i in range(5)])
    s.add_extras(["x"])
    s.append_batch(times(5, 8), [[i, 10 + i - 4] for i in range(5, 8)])
    kinds = [Aggregation.MIN, Aggregation.AVG, Aggregation.SUM, Aggregation.MAX, Aggregation.FIRST, Aggregation.LAST, Aggregation.COUNT]
    assert s.aggregate_many(0, ALL, [AggregateRequest(1, k) for k in kinds]) == ([0, 4, 36, 13, 0, 13, 8], 8)
    assert [s.aggregate(9, 9, 0, k) for k in kinds] == [0] * 7
    with pytest.raises(ValueError):
        s.aggregate(0, ALL, 2, "sum")
    with pytest.raises(ValueError):
        s.aggregate(0, ALL, 0, "median")
    with pytest.raises(ValueError):
        s.count(5, 4)


def test_clear_delete_close_and_conflicts(spark, tmp_path):
    s, other = opened(spark, tmp_path / "s", cap=5), None
    s.append_batch([1, 2, 3], [[1], [2], [3]])
    other = opened(spark, tmp_path / "s")
    s.append(4, [4])
    with pytest.raises(CommitConflict):
        other.append(9, [9])
    other.refresh()
    assert len(got(other)) == 4
    s.clear()
    assert got(s) == [] and s.stats().first().total_writes == 0
    s.append(0, [7])
    assert got(s) == [] and s.stats().first().total_records == 1
    s.append(8, [8])
    assert got(s) == [(8, [8])]
    s.sync()
    s.close()
    s.close()
    for call in (lambda: s.append(1, [1]), lambda: s.count(0, 1), s.stats, s.sync):
        with pytest.raises(SeriesStateError):
            call()
    assert s.total_columns == 0 and not s.is_open
    opened(spark, tmp_path / "s").delete()
    assert not (tmp_path / "s").exists()


@pytest.mark.parametrize("bad", [([], []), ([1], [[1], [2]]), ([1], [[1, 2]]), ([1], [[40_000]]), ([-1], [[1]])])
def test_bad_batches_change_nothing(spark, tmp_path, bad):
    s = opened(spark, tmp_path / "s")
    with pytest.raises(ValueError):
        s.append_batch(*bad)
    assert got(s) == []


def test_against_a_ring_model(spark, tmp_path):
    rng = random.Random(5)
    s, model, cap = opened(spark, tmp_path / "s", 2, ["a", "b"], 40), [], 40
    for _ in range(6):
        rows = [(rng.randrange(0, 50), [rng.randrange(-32768, 32768), rng.randrange(-5, 5)]) for _ in range(rng.randrange(1, 30))]
        s.append_batch([t for t, _ in rows], [v for _, v in rows])
        model = (model + rows)[-cap:] if cap else model + rows
        a, b = sorted((rng.randrange(0, 50), rng.randrange(0, 50)))
        assert got(s, a, b) == [r for r in model if r[0] and a <= r[0] <= b]
        if rng.random() < 0.5:
            cap = rng.choice([10, 25, 40, 80])
            s.resize(cap)
            model = model[-cap:]
    s.compact()
    assert got(s) == [r for r in model if r[0]]
    s.rebuild()
    assert got(s) == [r for r in model if r[0]]
    lost = s._store.new_name()
    spark.range(1).write.parquet(s._store.segment_path(lost))
    assert s._store.clean(s._manifest, older_than_ms=0) >= 1 and got(s) == [r for r in model if r[0]]


def test_append_frame_keeps_the_order_and_is_idempotent(spark, tmp_path):
    s = opened(spark, tmp_path / "s", 1, ["v"])
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "1 + (id * 7919) % 1000 as ts", "((id * 7919) % 1000) % 100 as v")
    assert s.append_frame(df, "k", query="q", batch=0) == 1000
    assert s.append_frame(df, "k", query="q", batch=0) == 0
    assert [t for t, _ in got(s)] == list(range(1, 1001))
    assert s.frame().orderBy("seq").select("seq").first()[0] == 0


def test_default_series_and_helpers(spark, tmp_path):
    default.init(spark, SeriesConfig(str(tmp_path / "d"), 2, max_records=capacity_for(10_000, 2)))
    default.init(spark, SeriesConfig(str(tmp_path / "other"), 1))
    default.write(5, [1, 2])
    default.write_batch([6, 7], [[3, 4], [5, 6]])
    with default.query(0, ALL, [1]) as q:
        assert [v for _, v in q] == [[2], [4], [6]]
    assert default.query_count(6, 7) == 2 and default.aggregate(0, ALL, 0, "sum") == 9
    default.add_extra_params(["x"])
    assert default.has_overflow() and default.get_total_params() == 3 and default.get_param_name(2) == "x"
    default.migrate_overflow([])
    default.resize(0)
    default.migrate_schema(["p1"])
    assert default.get_stats().first().num_params == 1
    default.clear()
    default.sync()
    default.close()
    assert not default.is_initialized() and default.get_total_params() == 0
    with pytest.raises(SeriesStateError):
        default.write(1, [1])


def test_streaming_ingest(spark, tmp_path):
    from tidemark.streaming import start_ingest

    s = opened(spark, tmp_path / "s", 1, ["v"])
    for k in range(2):
        spark.range(10).selectExpr(f"{100 * k + 1} + id as ts", "cast(id as smallint) as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts long, v short").parquet(str(tmp_path / "in"))
        start_ingest(stream, s, str(tmp_path / "check")).awaitTermination()
        s.refresh()
        assert s.count(0, ALL) == 10 * (k + 1)


def manifests(path):
    return sorted((path / "manifests").glob("*.json"))


@pytest.mark.parametrize("damage", [lambda raw: raw[: len(raw) // 2], lambda raw: b"", lambda raw: b"\xff\x00garbage", lambda raw: b'{"base": 3}', lambda raw: raw.replace(b'"total": 2', b'"total": -2')])
def test_a_damaged_manifest_is_passed_over(spark, tmp_path, damage):
    path = tmp_path / "s"
    s = opened(spark, path, 1, ["v"])
    s.append_batch([1, 2], [[1], [2]])
    s.append(3, [3])
    newest = manifests(path)[-1]
    raw = manifests(path)[-2].read_bytes() if damage(b'"total": 2') == b'"total": -2' else newest.read_bytes()
    newest.write_bytes(damage(raw))
    if damage(b"12") != b"1":  # else a file system that keeps checksums finds it
        (newest.parent / f".{newest.name}.crc").unlink()
    segments = {p.name for p in (path / "segments").iterdir()}
    s = opened(spark, path, 1, ["v"])
    assert got(s) == [(1, [1]), (2, [2])] and s._store.clean(s._manifest, older_than_ms=0) == 0
    assert {p.name for p in (path / "segments").iterdir()} == segments
    s.append(4, [4])
    s.append(5, [5])
    again = opened(spark, path, 1, ["v"])
    assert got(again) == [(1, [1]), (2, [2]), (4, [4]), (5, [5])] and len(manifests(path)) == 5


def test_lost_manifests_are_rebuilt_from_the_segments(spark, tmp_path):
    path = tmp_path / "s"
    s = opened(spark, path, 1, ["v"])
    s.append_batch([1, 2], [[1], [2]])
    s.append_frame(spark.range(3).selectExpr("id + 3 as ts", "id as v"), "ts")
    s.add_extras(["x"])
    s.append(9, [9, 90])
    before = got(s)
    for m in manifests(path)[1:]:
        m.write_bytes(b"")
        (m.parent / f".{m.name}.crc").unlink()
    manifests(path)[0].unlink()
    s = opened(spark, path, 1, ["v"])
    assert got(s) == before and s.has_extras
    s._store.forget()
    s = opened(spark, path, 1, ["v"], 4)
    assert got(s) == before[-4:]
    s.append(10, [1, 2])
    s.compact()
    s._store.forget()
    assert got(opened(spark, path, 1, ["v"], 4)) == [*before[-3:], (10, [1, 2])]


def test_a_full_disk_caps_the_series_once(spark, tmp_path, monkeypatch):
    s = opened(spark, tmp_path / "s", 1, ["v"], 100)
    s.append_batch([1, 2, 3], [[1], [2], [3]])
    write, left = s._store.write_rows, [1]

    def full(name, table):
        if left[0]:
            left[0] -= 1
            raise OSError(28, "No space left on device")
        write(name, table)

    monkeypatch.setattr(s._store, "write_rows", full)
    s.append(4, [4])
    assert got(s) == [(2, [2]), (3, [3]), (4, [4])] and s.stats().first().max_records == 3 and s.stats().first().total_evictions == 1
    left[0] = 1
    with pytest.raises(OSError):
        s.append(5, [5])
    s = opened(spark, tmp_path / "t", 1, ["v"])
    s.append(1, [1])
    monkeypatch.setattr(s._store, "write_rows", lambda *_: (_ for _ in ()).throw(OSError(28, "No space left on device")))
    with pytest.raises(CapacityError):
        s.append(2, [2])
    assert got(s) == [(1, [1])]


def test_columns_may_have_any_name_but_must_differ_whatever_their_case(spark, tmp_path):
    names = ["at", "part", "offset", "count", "c1", "first"]
    s = opened(spark, tmp_path / "s", 6, names)
    s.append(1, [1, 2, 3, 4, 5, 6])
    s.append_frame(spark.range(4).selectExpr("id + 2 as ts", *[f"cast(id as smallint) as {n}" for n in names]), "ts")
    assert got(s) == [(1, [1, 2, 3, 4, 5, 6]), *((k + 2, [k] * 6) for k in range(4))]
    for bad in (["A", "a"], ["Ts"], ["v", ""]):
        with pytest.raises(ValueError):
            SeriesConfig("x", len(bad), bad)
    with pytest.raises(ValueError):
        s.add_extras(["AT"])


def test_many_small_appends_are_merged(spark, tmp_path, monkeypatch):
    from tidemark import series

    monkeypatch.setattr(series, "FAN", 4)
    monkeypatch.setattr(series, "FAN_BITS", 2)
    s = opened(spark, tmp_path / "s", 1, ["v"])
    for k in range(30):
        s.append(k + 1, [k])
        assert len(s._manifest.segments) < 12
    assert got(s) == [(k + 1, [k]) for k in range(30)] and got(opened(spark, tmp_path / "s")) == got(s)
