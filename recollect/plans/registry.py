"""Every registered query with, where one exists, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


MODULES = ("listings", "joins", "aggregates", "scalars", "search", "upkeep", "ingest")

_entries: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under a name, with its SQL."""

    def add(f: Query) -> Query:
        if name in _entries:
            raise ValueError(f"two queries are named {name}")
        _entries[name] = Entry(f, sql)
        return f

    return add


def _load() -> dict[str, Entry]:
    """Importing a plan module registers its queries."""
    for name in MODULES:
        import_module(f"recollect.plans.{name}")
    return _entries


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in _load().items() if e.sql}
