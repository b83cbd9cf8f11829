"""A register of queries: each takes a session and a data folder, and may have SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import Fixtures, sql


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, statement: str | None = None, **extra: str) -> Callable:
        """Registers a function of Fixtures under its name, with DuckDB SQL over the views of fixtures and `extra` ones."""
        def add(f: Callable[[Fixtures], DataFrame]) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
            self.queries[f.__name__].__doc__ = f.__doc__
            if statement:
                self.sql[f.__name__] = sql(statement, extra=extra)
            return f

        return add
