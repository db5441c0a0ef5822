"""The registered queries as SQL for DuckDB, to check the Spark results against."""

from oracle.catalog import oracle_sql

__all__ = ["oracle_sql"]
