"""Registered queries over the driver tables, each with its DuckDB counterpart."""
