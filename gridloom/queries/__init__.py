"""Registered queries and the SQL that says the same; one module for each family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.queries import aggregates, edges, functions, imported, lenient, ml, relational, sinks, tpch, windows

MODULES = (tpch, relational, sinks, windows, aggregates, functions, edges, lenient, ml, imported)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in MODULES for name, (function, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
