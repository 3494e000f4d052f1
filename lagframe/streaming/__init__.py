"""Incremental ingest as file streams."""
