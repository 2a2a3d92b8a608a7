"""Structured Streaming forms of ingestion, windows and caches."""
