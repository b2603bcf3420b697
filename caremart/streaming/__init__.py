"""Structured Streaming adapters for the table-maintenance operators."""

from caremart.streaming.changes import apply_change_stream, latest_version

__all__ = ["apply_change_stream", "latest_version"]
