"""Named queries over a fixture, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerloom.plans.fixtures import Fixture, twin

QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None, **extra: str):
    """Register a function of a fixture; ``extra`` are common table expressions of the twin."""

    def add(f: Callable[[Fixture], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            TWINS[name] = twin(sql, extra)
        return f

    return add
