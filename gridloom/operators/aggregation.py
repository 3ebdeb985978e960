"""Aggregation: keys, masks, distinct and sorted inputs, grouping sets, distinct marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column | str], masks: dict[str, str] | None = None, ignore_null_keys: bool = False) -> DataFrame:
    """Group by ``keys``; each aggregate may have a mask, a predicate on the rows it takes. Without keys: one row, always."""
    if ignore_null_keys:
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
    masks = masks or {}
    columns = []
    for name, made in aggregates.items():
        if name in masks:
            if not isinstance(made, str):
                raise TypeError("a masked aggregate is given as SQL text")
            made = F.expr(f"{made} FILTER (WHERE {masks[name]})")
        columns.append((F.expr(made) if isinstance(made, str) else made).alias(name))
    return df.groupBy(*keys).agg(*columns)


def sorted_aggregate(df: DataFrame, keys: Sequence[str], name: str, value: str, by: Sequence[str | Column], descending: bool = False) -> DataFrame:
    """Values of each group in an array, ordered by other columns: names, or Columns with a direction and place of nulls of their own."""
    order = [(F.desc(c) if descending else F.asc(c)) if isinstance(c, str) else c for c in by]
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    listed = F.collect_list(F.struct(F.col("_place"), F.col(value).alias("v")))  # the operator's result: a group's values
    return placed.groupBy(*keys).agg(F.transform(F.array_sort(listed), lambda r: r["v"]).alias(name))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column, id_name: str | None = None) -> DataFrame:
    """Aggregates for several sets of keys in one pass; keys outside a row's set are null; ``id_name`` has Spark's grouping id."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    return grouped.agg(*aggregates, *([F.grouping_id().alias(id_name)] if id_name else []))


def group_id(df: DataFrame, sets: Sequence[Sequence[str]], inputs: Sequence[str], name: str) -> DataFrame:
    """Each row once for every grouping set, with the set's number; keys outside the set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = F.array(*(F.struct(*((F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys), F.lit(i).cast("long").alias(name)) for i, s in enumerate(sets)))
    return df.select(*(F.col(c).alias(f"_in_{c}") for c in inputs), F.explode(rows).alias("_row")).select("_row.*", *(F.col(f"_in_{c}").alias(c) for c in inputs))


def mark_distinct(df: DataFrame, marker: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a boolean that is true for the first row of each combination of keys, by ``order``."""
    return df.withColumn(marker, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
