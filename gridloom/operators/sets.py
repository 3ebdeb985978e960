"""Set operations, by column name; nulls are equal to each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*inputs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, inputs)


def union(*inputs: DataFrame) -> DataFrame:
    return union_all(*inputs).distinct()


def intersect(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    right = right.select(*left.columns)
    return left.intersectAll(right) if all_rows else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    right = right.select(*left.columns)
    return left.exceptAll(right) if all_rows else left.subtract(right)
