"""Incremental scans: source rows that keep arriving."""
