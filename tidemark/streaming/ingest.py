"""Streaming ingest: each micro-batch is one append, committed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..series import Series


def start_ingest(stream: DataFrame, series: Series, checkpoint: str, *, order_by: str | Sequence[str] = "ts", name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Append the rows of a stream (ts and all columns by name) to the series.

    Within a micro-batch rows arrive in the order of order_by. The batch's number is kept in the
    manifest with the rows, so a batch that is run again after a failure adds nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        series.refresh()
        series.append_frame(batch, order_by, query=name, batch=number)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
