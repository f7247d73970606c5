"""Where plan modules register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPECS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its DuckDB SQL; without SQL it is tested otherwise."""

    def keep(plan):
        if name in SPECS:
            raise ValueError(f"query {name!r} is registered twice")
        SPECS[name] = (plan, sql)
        return plan

    return keep
