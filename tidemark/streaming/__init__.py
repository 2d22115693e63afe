"""Structured Streaming into a series."""

from .ingest import start_ingest

__all__ = ["start_ingest"]
