"""Reader for the binary block files of embedded recorders.

A file is a packed little-endian header, a sparse index, blocks of BLOCK_BYTES, and possibly a region of
dense rows of extra columns. Blocks are a ring: ordinal k lies in slot k modulo the capacity. The
driver reads the header; tasks read ranges of ordinals, each record at its place. Files are opened by
the workers, so they must lie where all of them can open them.

    spark.dataSource.register(BlockFiles)
    spark.read.format("blockfile").option("path", path).load()
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, ShortType, StructField, StructType

#: The layout of the header, its magic numbers, and of the regions.
HEADER = "<II BBHH IIII II III II"
FILE_MAGIC, BLOCK_MAGIC, OVERFLOW_MAGIC = 0x45545344, 0x424C4B54, 0x4F564652
NAMES, NAME_BYTES, SHORT_NAME_BYTES = 16, 32, 20
HEADER_BYTES, OVERFLOW_HEADER_BYTES, BLOCK_BYTES, BLOCK_HEADER = 584, 1024, 1024, 8
TAIL = "<BBHII"


@dataclass(frozen=True)
class Layout:
    """Where things are in one file."""

    names: tuple[str, ...]
    extras: tuple[str, ...]
    per_block: int
    capacity: int
    total: int
    data_offset: int
    overflow_offset: int
    first_overflow: int

    @property
    def retained(self) -> int:
        return min(self.total, self.capacity) if self.capacity else self.total


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def layout(path: str) -> Layout:
    """Read and check a header; ValueError if it isn't one of a version with the present layout."""
    with open(path, "rb") as f:
        raw = f.read(HEADER_BYTES)
        if len(raw) < HEADER_BYTES:
            raise ValueError("the file is too short")
        fields = struct.unpack_from(HEADER, raw)
        magic, version, n, size, _, per_block, capacity, total, _, _, _, _, index_offset, entries, stride, _, _ = fields
        if magic != FILE_MAGIC or version not in (3, 4) or size != 2 or not 1 <= n <= 64 or per_block != (BLOCK_BYTES - BLOCK_HEADER) // (4 + 2 * n) or not stride:
            raise ValueError(f"not a block file of version 3 or 4: version {version}, {n} columns")
        at = struct.calcsize(HEADER)
        names = [_text(raw[at + k * NAME_BYTES : at + (k + 1) * NAME_BYTES]) for k in range(min(n, NAMES))]
        if n > NAMES:
            f.seek(HEADER_BYTES)
            more = f.read(SHORT_NAME_BYTES * (n - NAMES))
            names += [_text(more[k * SHORT_NAME_BYTES : (k + 1) * SHORT_NAME_BYTES]) for k in range(n - NAMES)]
        _, extra, _, overflow, first = struct.unpack_from(TAIL, raw, at + NAMES * NAME_BYTES)
        extras: list[str] = []
        if extra:
            f.seek(overflow)
            head = f.read(OVERFLOW_HEADER_BYTES)
            if struct.unpack_from("<I", head)[0] != OVERFLOW_MAGIC:
                raise ValueError("the region of extra columns has no header")
            extras = [_text(head[12 + k * SHORT_NAME_BYTES : 12 + (k + 1) * SHORT_NAME_BYTES]) for k in range(extra)]
    named = [x or f"p{k}" for k, x in enumerate(names)]
    return Layout(tuple(named), tuple(extras), per_block, capacity, total, index_offset + entries * 8, overflow, first)


@dataclass
class Ordinals(InputPartition):
    start: int
    end: int


class BlockFileReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int) -> None:
        self.path, self.per_partition, self.layout = path, per_partition, layout(path)

    def partitions(self) -> list[Ordinals]:
        first, end = self.layout.total - self.layout.retained, self.layout.total
        return [Ordinals(a, min(a + self.per_partition, end)) for a in range(first, end, self.per_partition)]

    def read(self, partition: Ordinals) -> Iterator[tuple]:
        m = self.layout
        with open(self.path, "rb") as f:
            number, block = -1, b""
            for k in range(partition.start, partition.end):
                at, row = divmod(k % m.capacity if m.capacity else k, m.per_block)
                if at != number:
                    f.seek(m.data_offset + at * BLOCK_BYTES)
                    number, block = at, f.read(BLOCK_BYTES)
                    if len(block) < BLOCK_HEADER or struct.unpack_from("<I", block)[0] != BLOCK_MAGIC:
                        raise ValueError(f"block {at} is damaged")
                (ts,) = struct.unpack_from("<I", block, BLOCK_HEADER + 4 * row)
                if not ts:
                    continue
                columns = BLOCK_HEADER + 4 * m.per_block
                values = [struct.unpack_from("<h", block, columns + 2 * (c * m.per_block + row))[0] for c in range(len(m.names))]
                extras = [0] * len(m.extras)
                if extras and k >= m.first_overflow:
                    f.seek(m.overflow_offset + OVERFLOW_HEADER_BYTES + (k - m.first_overflow) * 2 * len(extras))
                    raw = f.read(2 * len(extras))
                    if len(raw) == 2 * len(extras):
                        extras = list(struct.unpack(f"<{len(extras)}h", raw))
                yield (k, ts, *values, *extras)


class BlockFiles(DataSource):
    """Format "blockfile"; options path and records_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self) -> StructType:
        m = layout(self.options["path"])
        return StructType([StructField("seq", LongType()), StructField("ts", LongType()), *[StructField(n, ShortType()) for n in (*m.names, *m.extras)]])

    def reader(self, schema: StructType) -> BlockFileReader:
        return BlockFileReader(self.options["path"], int(self.options.get("records_per_partition", 1_000_000)))
