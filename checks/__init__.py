"""Queries that run every operator on the driver tables, with DuckDB oracles."""
