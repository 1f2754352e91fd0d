"""Registered queries over the driver tables, with DuckDB oracle SQL."""
