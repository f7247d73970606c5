"""Every query of the library with its DuckDB counterpart, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import catalogue

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: spec[0] for name, spec in catalogue.SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: spec[1] for name, spec in catalogue.SPECS.items() if spec[1]}
