"""Incremental ingest of fixed-width drops (Structured Streaming)."""

from tabulare.streaming.ingest import ingest_fwf_stream

__all__ = ["ingest_fwf_stream"]
