"""Composed query plans registered with the driver, and their DuckDB oracle SQL."""
