"""Continuous ingest of relation files with Structured Streaming."""
