"""Structured Streaming: incremental ingestion, windowed counts, orphan state."""
