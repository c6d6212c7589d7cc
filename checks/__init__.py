"""Registered queries with the DuckDB statements they are checked against."""
