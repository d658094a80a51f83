"""Test-data adapter, query registry and DuckDB oracle SQL."""
