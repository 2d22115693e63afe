"""A series: the operations of the engine on one stored, append-ordered table."""

from __future__ import annotations

import errno
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import AggregateRequest, Aggregation, aggregate, aggregate_many, range_count, range_scan, trimmed
from .plans.config import MAX_COLUMNS, MAX_EXTRAS, CapacityError, SeriesConfig, SeriesStateError, SizeModel, checked_names, records_per_block
from .sources.store import Manifest, Segment, Store

MAX_TS = 2**32 - 1
FAN_BITS = 6
FAN = 1 << FAN_BITS


class Query:
    """Rows of a range in arrival order, pulled one partition at a time; a context manager."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self._iterator: Iterator[Row] | None = None
        self._closed = False

    def next(self) -> tuple[int, list[int]]:
        """(ts, values) of the next row; StopIteration after the last one."""
        if self._closed:
            raise SeriesStateError("the query is closed")
        if self._iterator is None:
            self._iterator = self.rows.orderBy("seq").toLocalIterator()
        row = next(self._iterator)
        return row[1], list(row[2:])

    def __iter__(self) -> Iterator[tuple[int, list[int]]]:
        while True:
            try:
                yield self.next()
            except StopIteration:
                return

    def to_json(self) -> DataFrame:
        """The rows as JSON texts, for clients that take a stream of them."""
        return self.rows.orderBy("seq").select(F.to_json(F.struct(*[c for c in self.rows.columns if c != "seq"])).alias("json"))

    def close(self) -> None:
        self._iterator, self._closed = None, True

    def __enter__(self) -> Query:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Series:
    """One open series. Readers see the version that was current when they started."""

    def __init__(self, spark: SparkSession, config: SeriesConfig, store: Store, manifest: Manifest) -> None:
        self.spark, self.config, self._store, self._manifest, self._open = spark, config, store, manifest, True

    @classmethod
    def open(cls, spark: SparkSession, config: SeriesConfig) -> Series:
        """Open the series in config.path, or create it.

        An existing series keeps its own capacity and stride; its number of base columns must be
        config's. What crashed writers left is removed. If no manifest can be read, one is made from the
        segments and config.
        """
        store = Store(spark, config.path)
        if store.exists():
            try:
                manifest = store.load()
            except SeriesStateError:
                manifest = store.commit(None, store.recovered(config.columns, config.max_records, config.index_stride))
            if len(manifest.base) != config.num_params:
                raise ValueError(f"the series has {len(manifest.base)} base columns, not {config.num_params}")
            store.clean(manifest)
        else:
            base = [[n, f"c{k}"] for k, n in enumerate(config.columns)]
            manifest = store.commit(None, Manifest(base, [], config.max_records, config.index_stride, next_column=len(base)))
        return cls(spark, config, store, manifest)

    # State

    def _current(self) -> Manifest:
        if not self._open:
            raise SeriesStateError("the series is closed")
        return self._manifest

    def _commit(self, new: Manifest) -> None:
        self._manifest = self._store.commit(self._manifest, new)

    @property
    def store(self) -> Store:
        return self._store

    @property
    def is_open(self) -> bool:
        return self._open

    def refresh(self) -> None:
        """See what other writers have committed."""
        self._current()
        self._manifest = self._store.load()

    def sync(self) -> None:
        """Nothing to do: a commit is durable when it returns."""
        self._current()

    def close(self) -> None:
        """Closing again is allowed."""
        self._open = False

    def delete(self) -> None:
        """Close and remove all files."""
        self._current()
        self.close()
        self._store.remove()

    @property
    def total_columns(self) -> int:
        """Base and extra columns; 0 when closed."""
        return len(self._manifest.columns) if self._open else 0

    @property
    def has_extras(self) -> bool:
        return self._open and bool(self._manifest.extras)

    def column_name(self, place: int) -> str | None:
        """The name at a place, None beyond the last."""
        columns = self._current().columns
        return columns[place][0] if 0 <= place < len(columns) else None

    # Writing

    def append(self, ts: int, values: Sequence[int]) -> None:
        """One record: a small file and a commit, without a job."""
        self.append_batch([ts], [values])

    def append_batch(self, timestamps: Sequence[int], values: Sequence[Sequence[int]]) -> None:
        """Records in the given order, all or none. Timestamps may repeat and run backwards."""
        m = self._current()
        if not timestamps or len(timestamps) != len(values):
            raise ValueError("as many timestamps as value rows are needed, and one at least")
        width = len(m.columns)
        for k, (ts, row) in enumerate(zip(timestamps, values, strict=True)):
            if not 0 <= ts <= MAX_TS or len(row) != width or not all(-32768 <= v <= 32767 for v in row):
                raise ValueError(f"record {k}: {width} 16-bit values and a 32-bit timestamp are needed")
        held = {"ts": pa.array(timestamps, pa.int64())} | {c: pa.array([int(row[k]) for row in values], pa.int16()) for k, (_, c) in enumerate(m.columns)}

        def write(name: str, first: int) -> None:
            self._store.write_rows(name, pa.table({"seq": pa.array(range(first, first + len(timestamps)), pa.int64())} | held))

        self._append(write, len(timestamps), min(timestamps), max(timestamps))

    def append_frame(self, df: DataFrame, order_by: str | Sequence[str], *, query: str | None = None, batch: int | None = None) -> int:
        """The rows of df (ts and all columns by name), in the order of order_by; how many they are.

        Rows are sorted by range, so nothing passes through one task. query and batch make it
        idempotent: a batch number of a query that was already committed is left out.
        """
        m = self._current()
        if query is not None and m.batches.get(query, -1) >= batch:
            return 0
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        ts = F.col("ts").cast("long")
        valid = F.when(ts.between(0, MAX_TS), ts).otherwise(F.raise_error(F.lit("ts must be an unsigned 32-bit number of seconds")))
        ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # columns go by their stored names from here on, which meet no helper's
        staged = ordered.select(F.monotonically_increasing_id().alias("at"), valid.alias("ts"), *[F.coalesce(F.col(f"`{n}`").cast("short"), F.lit(0).cast("short")).alias(c) for n, c in m.columns])
        name = self._store.new_name()
        path = f"{self._store.path}/staging/{name}"
        staged.write.parquet(path)
        staged = self.spark.read.schema(staged.schema).parquet(path)
        # at holds the partition in its upper bits and the place in it below: as many counts as partitions
        part = F.shiftright("at", 33)
        counts = sorted(staged.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).collect())
        n = sum(c for _, c, _, _ in counts)
        if n:
            starts, at = {}, 0
            for p, c, _, _ in counts:
                starts[p], at = at, at + c
            offsets = self.spark.createDataFrame(list(starts.items()), "part long, offset long")
            numbered = staged.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("at", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))

            def write(name: str, first: int) -> None:
                numbered.select((F.col("at") + first).alias("seq"), "ts", *[c for _, c in m.columns]).write.mode("overwrite").parquet(self._store.segment_path(name))

            self._append(write, n, min(a for _, _, a, _ in counts), max(b for _, _, _, b in counts), {query: batch} if query is not None else None)
        elif query is not None:
            self._commit(replace(m, batches=m.batches | {query: batch}))
        self._store.drop("staging", name)
        return n

    def _append(self, write: Callable[[str, int], None], n: int, low: int, high: int, batches: dict[str, int] | None = None) -> None:
        """Commit n rows that write(segment, first stored number) puts on disk; their timestamps are low to high."""
        m = self._guarded(self._current(), n)
        name = self._store.new_name()
        try:
            write(name, m.end_stored)
        except Exception as e:
            if not _disk_full(e) or m.total == 0 or m.capped:
                raise
            self._store.drop("segments", name)
            m = self._with_space(replace(m, max_records=m.total, capped=True))
            try:
                write(name, m.end_stored)
            except Exception as again:
                raise CapacityError("no space is left even after capping the series") from again
        grown = replace(m, total=m.total + n, writes=m.writes + n, evictions=m.evictions + (max(0, m.total + n - max(m.total, m.max_records)) if m.max_records else 0), segments=[*m.segments, Segment(name, m.end_stored, m.end_stored + n - 1, low, high)], batches=m.batches | (batches or {}))
        self._commit(replace(grown, segments=grown.live()))
        self._merge_small()

    def _merge_small(self) -> None:
        """Merge the newest segments once there are FAN of one order of size, so their number grows with the logarithm of the rows."""
        segments = self._current().segments
        order = lambda s: (s.hi - s.lo + 1).bit_length() // FAN_BITS
        for k in range(64 // FAN_BITS + 1):
            run = list(takewhile(lambda s: order(s) <= k, reversed(segments)))
            if len(run) >= FAN:
                return self._merge(run[::-1])
            if len(run) == len(segments):
                return None
        return None

    def _guarded(self, m: Manifest, n: int) -> Manifest:
        """m, capped where a block of the size model would begin while free space is below the reserve."""
        probe, reserve = self.config.free_space, self.config.min_free_bytes
        if probe is None or not reserve or m.capped or not m.max_records or m.total >= m.max_records:
            return m
        block = records_per_block(len(m.base))
        boundary = max(block, -(-m.total // block) * block)
        if boundary >= min(m.total + n, m.max_records):
            return m
        free = probe()
        return replace(m, max_records=boundary, capped=True) if free is not None and free < reserve else m

    def _with_space(self, m: Manifest) -> Manifest:
        """m, with files of evicted rows removed from the disk."""
        live = {s.name for s in m.live()}
        for s in m.segments:
            if s.name not in live:
                self._store.drop("segments", s.name)
        return replace(m, segments=m.live())

    # Reading

    def frame(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Retained rows: seq, ts and all columns; start and end only help to read less."""
        return self._store.rows(self._current(), start, end)

    def query(self, start: int, end: int, columns: list[int] | None = None, *, strict_order: bool = False) -> Query:
        return Query(self.scan(start, end, columns, strict_order=strict_order))

    def scan(self, start: int, end: int, columns: list[int] | None = None, *, strict_order: bool = False) -> DataFrame:
        """Rows of a range as a DataFrame; see range_scan()."""
        return range_scan(self.frame() if strict_order else self.frame(start, end), start, end, columns, strict_order=strict_order)

    def count(self, start: int, end: int) -> int:
        return range_count(self.frame(start, end), start, end).first()[0]

    def aggregate(self, start: int, end: int, column: int, kind: Aggregation | str) -> int:
        return aggregate(self.frame(start, end), start, end, column, kind).first()[0]

    def aggregate_many(self, start: int, end: int, requests: list[AggregateRequest]) -> tuple[list[int], int]:
        """Results in the order of the requests, and the number of rows."""
        row = aggregate_many(self.frame(start, end), start, end, requests).first()
        return list(row[:-1]), row[-1]

    def view(self, name: str) -> None:
        """Name the retained rows for spark.sql()."""
        self.frame().createOrReplaceTempView(name)

    # Evolution

    def add_extras(self, names: list[str]) -> None:
        """Add columns; rows before them read as 0."""
        m = self._current()
        if not 1 <= len(names) <= MAX_EXTRAS or len(m.base) + len(names) > MAX_COLUMNS:
            raise ValueError(f"1 to {MAX_EXTRAS} extra columns, {MAX_COLUMNS} in all")
        if m.extras:
            raise SeriesStateError("extra columns are already there")
        checked_names([n for n, _ in m.base] + list(names))
        self._commit(replace(m, extras=[[n, f"c{m.next_column + k}"] for k, n in enumerate(names)], next_column=m.next_column + len(names)))

    def migrate_extras(self, names: list[str]) -> None:
        """Make these the extra columns: those with a known name keep their values, others read as 0."""
        m = self._current()
        if [n for n, _ in m.extras] == list(names):
            return
        if not m.extras:
            return self.add_extras(names)
        if len(names) > MAX_EXTRAS or len(m.base) + len(names) > MAX_COLUMNS:
            raise ValueError(f"at most {MAX_EXTRAS} extra columns, {MAX_COLUMNS} in all")
        checked_names([n for n, _ in m.base] + list(names))
        extras, following = _mapped(m.extras, names, m.next_column)
        self._commit(replace(m, extras=extras, next_column=following))

    def migrate_schema(self, names: list[str], *, free_space_bytes: int = 0, allow_trim: bool = False, progress: Callable[[int, int], None] | None = None, progress_every: int = 0) -> None:
        """Make these the base columns, in this order; extras named become base columns, others go.

        New columns read as 0 in all rows. Only the manifest changes, as columns are stored under names
        of their own. Counters restart at the number of rows kept. The space budget is checked against
        the size model, and with allow_trim the newest rows that fit are kept and capacity follows.
        """
        names = checked_names(names)
        m = self._current()
        if names == [n for n, _ in m.columns] and not m.extras:
            return
        self._rewrite(names, m.max_records, free_space_bytes, allow_trim, progress, progress_every)

    def resize(self, max_records: int, *, free_space_bytes: int = 0, allow_trim: bool = False, progress: Callable[[int, int], None] | None = None, progress_every: int = 0) -> None:
        """Change the capacity (0: unlimited). Shrinking keeps the newest rows.

        If nothing was ever evicted, all rows fit and there are no extras, only the capacity changes.
        Otherwise extras become base columns and counters restart, as in migrate_schema().
        """
        m = self._current()
        if max_records < 0:
            raise ValueError("max_records must not be negative")
        if max_records == m.max_records:
            return
        linear = not m.max_records or m.total <= m.max_records
        if linear and (not max_records or max_records >= m.total) and not m.extras:
            self._commit(replace(m, max_records=max_records, capped=False))
            return
        self._rewrite([n for n, _ in m.columns], max_records, free_space_bytes, allow_trim, progress, progress_every)

    def _rewrite(self, names: list[str], max_records: int, free: int, allow_trim: bool, progress: Callable[[int, int], None] | None, every: int) -> None:
        m = self._current()
        keep = min(m.retained, max_records) if max_records else m.retained
        fit = trimmed(keep, SizeModel(len(names), max_records, m.index_stride), free, allow_trim)
        if fit < keep:
            model = SizeModel(len(names), max_records, m.index_stride)
            room = trimmed_room(model, free)
            max_records = min(max_records, room) if max_records else room
        keep = fit
        base, following = _mapped(m.columns, names, m.next_column)
        if progress:
            progress(0, keep)
        new = replace(m, base=base, extras=[], next_column=following, max_records=max_records, origin=m.end_stored - keep, total=keep, writes=keep, evictions=0, capped=False)
        self._commit(replace(new, segments=new.live()))
        if progress:
            for done in range(every, keep, every) if every else ():
                progress(done, keep)
            progress(keep, keep)

    # Maintenance

    def stats(self) -> DataFrame:
        """One row of counters, bounds and sizes; total_records are those retained."""
        m = self._current()
        bounds = self.frame().agg(F.coalesce(F.min_by("ts", "seq"), F.lit(0).cast("long")).alias("oldest_timestamp"), F.coalesce(F.max_by("ts", "seq"), F.lit(0).cast("long")).alias("newest_timestamp"))
        number = lambda v: F.lit(v).cast("long")
        return bounds.select(number(m.retained).alias("total_records"), number(m.max_records).alias("max_records"), "oldest_timestamp", "newest_timestamp", number(m.writes).alias("total_writes"), number(m.evictions).alias("total_evictions"), number(self._store.bytes(m)).alias("storage_bytes"), F.lit(len(m.base)).alias("num_params"), F.lit(len(m.extras)).alias("extra_params"), F.lit(None).cast("long").alias("buffer_pool_size"), F.lit(False).alias("using_paged_allocation"))

    def clear(self) -> None:
        """Remove all rows and reset the counters; columns and capacity stay."""
        m = self._current()
        self._commit(replace(m, origin=m.end_stored, total=0, writes=0, evictions=0, segments=[]))

    def compact(self, target_rows: int = 50_000_000) -> None:
        """Rewrite the retained rows into few files in arrival order; nothing else changes."""
        m = self._current()
        if len(m.segments) > 1:
            self._merge(m.live(), target_rows)

    def _merge(self, merged: list[Segment], target_rows: int = 50_000_000) -> None:
        """Rewrite neighbouring segments as one; rows that are not retained go."""
        m = self._current()
        lo, hi = max(merged[0].lo, m.first_stored), min(merged[-1].hi, m.end_stored - 1)
        raw = self.spark.read.schema(T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.LongType()), *[T.StructField(c, T.ShortType()) for _, c in m.columns]])).parquet(*[self._store.segment_path(s.name) for s in merged])
        raw = raw.where((F.col("seq") >= lo) & (F.col("seq") <= hi))
        name = self._store.new_name()
        raw.repartitionByRange(max(1, -(-(hi - lo + 1) // target_rows)), "seq").sortWithinPartitions("seq").write.parquet(self._store.segment_path(name))
        names = {s.name for s in merged}
        one = Segment(name, lo, hi, min(s.ts_min for s in merged), max(s.ts_max for s in merged))
        self._commit(replace(m, segments=sorted([*(s for s in m.live() if s.name not in names), one], key=lambda s: s.lo)))

    def rebuild(self) -> None:
        """Make the manifest's bounds and counts anew from the segments that it names."""
        m = self._current()
        segments = self._store.bounds([s.name for s in m.segments])
        end = max((s.hi + 1 for s in segments), default=m.origin)
        self._commit(replace(m, segments=segments, total=end - m.origin))

    def __enter__(self) -> Series:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def trimmed_room(model: SizeModel, free_space_bytes: int) -> int:
    from .plans.config import usable

    return model.fit(usable(free_space_bytes))


def _mapped(old: Iterable[Sequence[str]], names: list[str], following: int) -> tuple[list[list[str]], int]:
    """Stored names for new columns: those of old ones with the same name, new ones else."""
    known, out = dict(old), []
    for n in names:
        if n in known:
            out.append([n, known[n]])
        else:
            out.append([n, f"c{following}"])
            following += 1
    return out, following


def _disk_full(e: Exception) -> bool:
    return isinstance(e, OSError) and e.errno == errno.ENOSPC or "No space left on device" in str(e)
