"""Joins: equi and theta, outer, semi and anti, as filters or as match columns, with the null rules of IN and EXISTS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}
_STRATEGY = {None: None, "hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def _on(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], residual: Column | None) -> Column:
    condition = None
    for a, b in zip(left_keys, right_keys, strict=True):
        condition = left[a] == right[b] if condition is None else condition & (left[a] == right[b])
    return condition if residual is None else condition & residual


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", residual: Column | None = None, strategy: str | None = None) -> DataFrame:
    """Equi-join with an optional residual predicate. ``strategy`` hints hash, merge or broadcast; by default the planner, which knows sizes, decides."""
    right_side = right.hint(_STRATEGY[strategy]) if strategy else right
    return left.join(right_side, _on(left, right, left_keys, right_keys, residual), _HOW[how])


def nested_loop_join(left: DataFrame, right: DataFrame, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on any predicate, or the product of both sides without one."""
    return left.crossJoin(right) if condition is None else left.join(right, condition, _HOW[how])


def semi_filter(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], residual: Column | None = None) -> DataFrame:
    """Rows of ``left`` with a match (EXISTS); swap the sides for a right semi join."""
    return left.join(right, _on(left, right, left_keys, right_keys, residual), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, null_aware: bool = False) -> DataFrame:
    """Rows of ``left`` without a match: NOT EXISTS, or NOT IN if ``null_aware``.

    NOT IN: every row if ``right`` is empty; no row if ``right`` has a null key; else rows whose key is not null and has
    no match. The facts about ``right`` are one aggregated row, so nothing of unknown size is broadcast.
    """
    if not null_aware:
        return left.join(right, left[left_key] == right[right_key], "left_anti")
    facts = right.agg(F.count("*").alias("_rows"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("_nulls"))
    kept = left.join(right.select(F.col(right_key).alias("_key")), left[left_key] == F.col("_key"), "left_anti")
    judged = kept.crossJoin(F.broadcast(facts))  # one row
    return judged.filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_rows", "_nulls")


def semi_project(left: DataFrame, right: DataFrame, left_key: str, right_key: str, match: str, null_aware: bool = False) -> DataFrame:
    """All rows of ``left`` with a boolean: whether the key has a match (EXISTS), or the value of IN if ``null_aware``.

    The value of IN: true if there is a match; false if ``right`` is empty; null if the key is null or ``right`` has a
    null key; else false.
    """
    keys = right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_key")).distinct()
    found = left.join(keys, left[left_key] == F.col("_key"), "left")
    if not null_aware:
        return found.withColumn(match, F.col("_key").isNotNull()).drop("_key")
    facts = right.agg(F.count("*").alias("_rows"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("_nulls"))
    value = F.when(F.col("_key").isNotNull(), True).when(F.col("_rows") == 0, False).when(F.col(left_key).isNull() | (F.col("_nulls") > 0), F.lit(None).cast("boolean")).otherwise(False)
    return found.crossJoin(F.broadcast(facts)).withColumn(match, value).drop("_key", "_rows", "_nulls")
