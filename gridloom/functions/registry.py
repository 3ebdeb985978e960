"""User functions: scalar, vector and aggregate, usable as Columns and, once registered, by name in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(result: str) -> Callable:
    """A function of single values; rows travel in Arrow batches."""
    return lambda f: F.udf(f, result, useArrow=True)


def vector(result: str) -> Callable:
    """A function of pandas Series to a Series, a batch at a time."""
    return lambda f: F.pandas_udf(f, result)


def aggregate(result: str) -> Callable:
    """A function of pandas Series to one value, over groups and windows; a group must fit a task, so prefer expressions."""
    return lambda f: F.pandas_udf(f, result)


def register(spark: SparkSession, name: str, function) -> None:
    """Make a function known to SQL under a name."""
    spark.udf.register(name, function)
