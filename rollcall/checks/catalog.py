"""All registered queries."""

from rollcall.checks import file_checks, match_checks, schema_checks, values_checks  # noqa: F401
from rollcall.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
