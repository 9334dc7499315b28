"""Composite dataflows: ingest, listing queries, routing and maintenance."""
