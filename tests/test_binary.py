import struct

from tidemark.sources.binary import BlockFiles, layout


def write_block_file(path, names, capacity, rows, extras=(), first_overflow=0, extra_rows=()):
    """A file as a recorder leaves it after len(rows) records."""
    n, stride = len(names), 380
    per_block = (1024 - 8) // (4 + 2 * n)
    index_offset = 2048 if n > 16 else 1024
    entries = capacity // stride + 1 if capacity else 256
    slots = capacity or len(rows)
    blocks = bytearray(1024 * -(-slots // per_block))
    for k, (ts, values) in enumerate(rows):
        b, r = divmod(k % capacity if capacity else k, per_block)
        struct.pack_into("<IHH", blocks, 1024 * b, 0x424C4B54, r + 1, 0)
        struct.pack_into("<I", blocks, 1024 * b + 8 + 4 * r, ts)
        for c, v in enumerate(values):
            struct.pack_into("<h", blocks, 1024 * b + 8 + 4 * per_block + 2 * (c * per_block + r), v)
    overflow = index_offset + 8 * entries + len(blocks) if extras else 0
    head = struct.pack("<IIBBHHIIIIIIIIIII", 0x45545344, 4 if n > 16 else 3, n, 2, 4 + 2 * n, per_block, capacity, len(rows), 0, 0, 0, 0, index_offset, entries, stride, len(rows), 0)
    head += b"".join(x.encode().ljust(32, b"\0") for x in names[:16]).ljust(512, b"\0")
    head += struct.pack("<BBHII", n, len(extras), 2 * len(extras), overflow, first_overflow) + b"\0\0"
    assert len(head) == 584
    out = bytearray(head.ljust(index_offset + 8 * entries, b"\0"))
    for k, x in enumerate(names[16:]):
        out[584 + 20 * k : 584 + 20 * k + len(x)] = x.encode()
    out += blocks
    if extras:
        out += (struct.pack("<IB3xI", 0x4F564652, len(extras), first_overflow) + b"".join(x.encode().ljust(20, b"\0") for x in extras)).ljust(1024, b"\0")
        out += b"".join(struct.pack(f"<{len(extras)}h", *r) for r in extra_rows)
    path.write_bytes(out)


def test_wrapped_ring_with_extras(spark, tmp_path):
    rows = [(1000 + i, [i, -i, 7]) for i in range(250)]
    write_block_file(tmp_path / "a", ["a", "b", "c"], 200, rows, ["x"], 240, [[i] for i in range(10)])
    spark.dataSource.register(BlockFiles)
    df = spark.read.format("blockfile").option("path", str(tmp_path / "a")).option("records_per_partition", 64).load()
    assert [tuple(r) for r in df.orderBy("seq").collect()] == [(i, 1000 + i, i, -i, 7, max(0, i - 240) if i >= 240 else 0) for i in range(50, 250)]


def test_wide_file(spark, tmp_path):
    names = [f"n{k:02d}" for k in range(20)]
    write_block_file(tmp_path / "w", names, 0, [(5, list(range(20))), (0, [1] * 20), (6, [2] * 20)])
    assert layout(str(tmp_path / "w")).names == tuple(names)
    spark.dataSource.register(BlockFiles)
    df = spark.read.format("blockfile").option("path", str(tmp_path / "w")).load()
    assert [tuple(r) for r in df.collect()] == [(0, 5, *range(20)), (2, 6, *[2] * 20)]


def test_other_files_are_refused(tmp_path):
    import pytest

    for raw in (b"", b"x" * 5000):
        (tmp_path / "x").write_bytes(raw)
        with pytest.raises(ValueError):
            layout(str(tmp_path / "x"))
