"""Queries of a module by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """base: the tables, as common table expressions, that the module's SQL begins with."""

    def __init__(self, base: str):
        self.base, self.queries, self.oracle = base, {}, {}

    def __call__(self, name: str, sql: str | None = None, base: str | None = None) -> Callable:
        def put(f):
            self.queries[name] = f
            if sql is not None:
                body = sql.strip()
                self.oracle[name] = f"WITH {base or self.base}" + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")
            return f

        return put
