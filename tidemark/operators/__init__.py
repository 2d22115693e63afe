"""Operators over frames of seq, ts and 16-bit columns."""

from .aggregate import AggregateRequest, Aggregation, aggregate, aggregate_many
from .retain import newest, trimmed
from .scan import project, range_count, range_scan

__all__ = ["AggregateRequest", "Aggregation", "aggregate", "aggregate_many", "newest", "project", "range_count", "range_scan", "trimmed"]
