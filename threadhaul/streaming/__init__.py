"""Structured Streaming forms of page ingest and rates."""
