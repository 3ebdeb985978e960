"""Order, limits, and how rows are dealt to partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_of(*keys: str) -> list[Column]:
    """Sort keys from text such as ``"a DESC NULLS FIRST"``; ascending, nulls last by default."""
    out = []
    for key in keys:
        name, *rest = key.split()
        words = " ".join(rest).upper()
        down, first = "DESC" in words.split(), "NULLS FIRST" in words
        column = F.col(name)
        out.append((column.desc_nulls_first() if first else column.desc_nulls_last()) if down else (column.asc_nulls_first() if first else column.asc_nulls_last()))
    return out


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys_of(*keys))


def sort_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """A partial sort: every partition on its own."""
    return df.sortWithinPartitions(*keys_of(*keys))


def merge_sorted(*inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ordered stream of several."""
    out = inputs[0]
    for more in inputs[1:]:
        out = out.unionByName(more)
    return order_by(out, *keys)


def top_n(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by the keys: a heap in each task, merged, not a full sort."""
    return order_by(df, *keys).limit(n)


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(count)


def repartition(df: DataFrame, kind: str, n: int, *keys: str) -> DataFrame:
    """Deal rows to n partitions: 'hash' or 'range' by keys, 'round_robin', 'gather' into few without a shuffle."""
    if kind == "hash":
        return df.repartition(n, *keys)
    if kind == "range":
        return df.repartitionByRange(n, *keys)
    if kind == "gather":
        return df.coalesce(n)
    if kind == "round_robin":
        return df.repartition(n)
    raise ValueError(f"no such partitioning: {kind}")
