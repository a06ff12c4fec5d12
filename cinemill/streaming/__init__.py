"""Structured Streaming ingest and change feeds."""
