"""Queries over the driver's tables, by name, and the same in DuckDB SQL."""

from strandlake.plans import forms, relations  # noqa: F401  (their queries are added to the tables)
from strandlake.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
