"""Operators on single rows: filter, project, unnest, expand, unique ids, single-row enforcement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(expression: Column | str) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def filter_rows(df: DataFrame, *predicates: Column | str) -> DataFrame:
    """Rows for which every predicate is true; each conjunct is pushed on its own."""
    for predicate in predicates:
        df = df.filter(as_column(predicate))
    return df


def project(df: DataFrame, *expressions: Column | str, append: bool = False) -> DataFrame:
    """Computed columns, beside the ones there are if ``append``."""
    return df.select(*(["*"] if append else []), *map(as_column, expressions))


def unnest(df: DataFrame, replicate: Sequence[str], columns: Sequence[str], ordinality: str | None = None) -> DataFrame:
    """One row for each position of several arrays or maps, in lock-step: shorter ones are null at their end.

    An array gives column ``<name>_e``, a map ``<name>_k`` and ``<name>_v``. A row whose collections are all null or
    empty gives no row. ``ordinality`` names a column that counts from 1.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts, names = [], []
    for c in columns:
        if isinstance(kinds[c], T.MapType):
            parts += [F.map_keys(c).alias(f"{c}_k"), F.map_values(c).alias(f"{c}_v")]
            names += [f"{c}_k", f"{c}_v"]
        else:
            parts.append(F.col(c).alias(f"{c}_e"))
            names.append(f"{c}_e")
    empty = [F.coalesce(p, F.array()).alias(n) for p, n in zip(parts, names, strict=True)]
    rows = df.select(*replicate, F.posexplode(F.arrays_zip(*empty)).alias("_at", "_row"))
    out = [*replicate, *(F.col(f"_row.{n}").alias(n) for n in names)]
    return rows.select(*out, *([(F.col("_at") + 1).cast("long").alias(ordinality)] if ordinality else []))


def expand(df: DataFrame, projections: Sequence[Sequence[Column | str]], names: Sequence[str]) -> DataFrame:
    """Each row once for every projection, in one pass over the input."""
    rows = F.array(*(F.struct(*(as_column(e).alias(n) for e, n in zip(p, names, strict=True))) for p in projections))
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def assign_unique_id(df: DataFrame, name: str) -> DataFrame:
    """A 64-bit id unique among all rows: partition number and position; not consecutive."""
    return df.withColumn(name, F.monotonically_increasing_id())


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The one row of the input; a row of nulls if there is none; an error at run time if there are more."""
    first = df.limit(2).agg(F.count("*").alias("n"), F.first(F.struct("*")).alias("row"))
    checked = first.select(F.when(F.col("n") > 1, F.raise_error(F.lit("Expected single row of input. Received more."))).otherwise(F.lit(0)).alias("ok"), "row")
    return checked.filter("ok = 0").select("row.*")
