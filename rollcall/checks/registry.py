"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its counterpart."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
