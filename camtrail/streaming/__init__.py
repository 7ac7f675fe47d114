"""Incremental ingest of results."""
