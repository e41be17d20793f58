"""Collects a module's plans: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable


class Plans(dict):
    """A mapping of plans with a decorator that adds one."""

    def add(self, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self[f.__name__] = (f, sql)
            return f

        return put
