"""Documents in chunks: rows of some megabytes of text with numbers that stay the same.

Operators that ask for facts about a place in the corpus (is this window repeated, how frequent is this
word) send out places, chunk and position in one number, and get the answers back by chunk. Facts that
many chunks ask for are asked once for a group of chunks. The chunks are written once, so every pass
sees the same places, whatever is retried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, record_batch, slices, stored

PLACE_BITS = 32
_SEQUENCE_BITS = 11
SCHEMA = "chunk long, grp long, size long, payload binary"


def chunked(docs: DataFrame, max_bytes: int = 4 << 20, group: int | None = None) -> DataFrame:
    """chunk, grp, size (bytes of text) and payload (doc_id and text of its rows, compressed), stored.

    A group is a run of chunks of one task. With group (bytes of text), tasks are merged until each has
    about as much, and cut into groups of that size; else each chunk is its own group.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, first = TaskContext.get().partitionId(), 0, 0
        if task >> 63 - PLACE_BITS - _SEQUENCE_BITS:
            raise ValueError("too many tasks to number their chunks; read larger partitions")
        for k, batch in enumerate(slices(batches, max_bytes=max_bytes)):
            if k >> _SEQUENCE_BITS:
                raise ValueError(f"a task reads over {1 << _SEQUENCE_BITS} chunks; read smaller partitions")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            size = sum(len(x.as_buffer()) for x in batch.column("text") if x.is_valid)
            if not group or at >= 1.5 * group:
                at, first = 0, k
            at += size
            yield record_batch(SCHEMA, {"chunk": [task << _SEQUENCE_BITS | k], "grp": [task << _SEQUENCE_BITS | first], "size": [size], "payload": [sink.getvalue().to_pybytes()]})

    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if group:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        docs = docs.coalesce(max(1, -(-total // group)))
    return stored(docs.mapInArrow(pack, SCHEMA), "chunks")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """The other columns of each chunk's row, and its documents."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "payload"]
        for k in range(batch.num_rows):
            with pa.ipc.open_stream(batch.column("payload")[k].as_buffer()) as docs:
                for part in docs:
                    yield {c: batch.column(c)[k] for c in others}, part
