"""Readers for paged, HTML and JSON sources."""
