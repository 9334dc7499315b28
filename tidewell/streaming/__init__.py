"""Incremental ingest and stateful source control."""
