"""Window operators, and window functions whose arguments are columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(df: DataFrame, functions: dict[str, Column | str], partition: Sequence[str], order: Sequence[Column | str] = (), frame: tuple[str, int, int] | None = None) -> DataFrame:
    """Window functions or aggregates over one specification; frame is ('rows' or 'range', from, to)."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    if frame:
        spec = spec.rowsBetween(*frame[1:]) if frame[0] == "rows" else spec.rangeBetween(*frame[1:])
    return df.withColumns({name: (F.expr(f) if isinstance(f, str) else f).over(spec) for name, f in functions.items()})


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, limit: int | None = None) -> DataFrame:
    """Numbers within each key as bigint, at most ``limit`` rows a key."""
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return numbered if limit is None else numbered.filter(F.col(name) <= limit)


def top_n_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, name: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each key; Catalyst cuts groups before the shuffle too."""
    number = name or "_number"
    spec = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(number, F.row_number().over(spec)).filter(F.col(number) <= limit)
    return kept.withColumn(number, F.col(number).cast("long")) if name else kept.drop(number)


def ntile_by(df: DataFrame, tiles: str, partition: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """ntile with the number of tiles in a column: the larger tiles come first; an error unless it is positive."""
    whole = Window.partitionBy(*partition)
    at = F.row_number().over(whole.orderBy(*order)) - 1
    rows, n = F.count("*").over(whole), F.when(F.col(tiles) > 0, F.col(tiles)).otherwise(F.raise_error(F.lit("tiles must be positive")).cast("long"))
    small, large = F.floor(rows / n), rows % n
    split = large * (small + 1)
    tile = F.when(at < split, F.floor(at / (small + 1))).otherwise(large + F.floor((at - split) / F.greatest(small, F.lit(1))))
    return df.withColumn(name, (tile + 1).cast("long"))


def shift_by(df: DataFrame, value: str, offset: str, partition: Sequence[str], order: Sequence[Column | str], name: str, default: Column | None = None) -> DataFrame:
    """lag with the offset in a column (negative: lead), by a join on row numbers; null offsets give null."""
    spec = Window.partitionBy(*partition).orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(spec).cast("long"))
    source = numbered.select(*(F.col(p).alias(f"_{p}") for p in partition), F.col("_at").alias("_from"), F.col(value).alias("_value"), F.lit(True).alias("_there"))
    on = F.col("_at") - F.col(offset) == F.col("_from")
    for p in partition:
        on = on & F.col(p).eqNullSafe(F.col(f"_{p}"))
    found = numbered.join(source, on, "left")
    return found.withColumn(name, F.when(F.col("_there"), F.col("_value")).otherwise(F.when(F.col(offset).isNotNull(), F.lit(None) if default is None else default))).select(*df.columns, name)
