"""Aggregates by name. Those that one expression says are Columns; those that need a second grouping are functions of a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

lit = F.lit


def _kept(x: Column) -> Column:
    """All values with their nulls: a struct isn't null."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def _kurtosis(x: Column) -> Column:
    n, g = F.count(x).cast("double"), F.kurtosis(x.cast("double"))
    return F.when(F.count(x) >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def _entropy(c: Column) -> Column:
    total = F.sum(c).cast("double")
    return F.when(F.coalesce(total, lit(0.0)) == 0, 0.0).otherwise(F.greatest(F.log2(total) - F.sum(F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)) / total, lit(0.0)))


def _first_by_key(entries: Column) -> Column:
    """Entries in order of key and value, the first of each key."""
    ordered = F.array_sort(entries)
    return F.filter(ordered, lambda e, i: (i == 0) | ~e["key"].eqNullSafe(F.get(ordered, i - 1)["key"]))


def _map_agg(k: Column, v: Column) -> Column:
    entries = F.filter(F.collect_list(F.struct(k.alias("key"), v.alias("value"))), lambda e: e["key"].isNotNull())
    return F.map_from_entries(_first_by_key(entries))


def _map_union(m: Column) -> Column:
    return F.map_from_entries(_first_by_key(F.flatten(F.collect_list(F.map_entries(m)))))


def _reduce_agg(x: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.array_sort(F.collect_list(x)), start, step)


AGGREGATES: dict[str, Callable[..., Column]] = {
    "approx_distinct": lambda x, e=0.023: F.approx_count_distinct(x, e), "approx_set": F.hll_sketch_agg, "merge": F.hll_union_agg, "approx_percentile": lambda x, p, accuracy=10000: F.percentile_approx(x, p, accuracy), "arbitrary": F.any_value, "any_value": F.any_value,
    "array_agg": _kept, "avg": F.avg, "bitwise_or_agg": F.bit_or, "bitwise_and_agg": F.bit_and, "bitwise_xor_agg": F.bit_xor, "bool_and": F.bool_and, "every": F.every, "bool_or": F.bool_or, "kurtosis": _kurtosis,
    "skewness": lambda x: F.when(F.count(x) >= 3, F.skewness(x.cast("double"))), "checksum": lambda x: F.bit_xor(F.xxhash64(x)), "count": lambda x=None: F.count("*" if x is None else x), "count_if": F.count_if,
    "covar_pop": F.covar_pop, "covar_samp": F.covar_samp, "corr": F.corr, "regr_intercept": F.regr_intercept, "regr_slope": F.regr_slope, "entropy": _entropy, "geometric_mean": lambda x: F.exp(F.avg(F.ln(x.cast("double")))),
    "map_agg": _map_agg, "map_union": _map_union, "max_data_size_for_stats": lambda x: F.max(F.octet_length(x.cast("string"))), "sum_data_size_for_stats": lambda x: F.sum(F.octet_length(x.cast("string"))),
    "min": F.min, "max": F.max, "min_by": F.min_by, "max_by": F.max_by, "reduce_agg": _reduce_agg, "set_agg": F.collect_set, "set_union": lambda a: F.array_distinct(F.flatten(F.collect_list(a))), "sum": F.sum,
    "stddev": F.stddev, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "variance": F.variance, "var_pop": F.var_pop, "var_samp": F.var_samp, "bit_xor": F.bit_xor, "first": F.first,
    "first_ignore_null": lambda x: F.first(x, ignorenulls=True), "last": F.last, "last_ignore_null": lambda x: F.last(x, ignorenulls=True),
    "array_cat": lambda block, index: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), block.alias("b")))), lambda s: s["b"])),
}


def agg(name: str, *arguments) -> Column:
    try:
        return AGGREGATES[name.lower()](*arguments)
    except KeyError:
        raise ValueError(f"no such aggregate: {name}") from None


def top_values(df: DataFrame, keys: Sequence[str], x: str, n: int, name: str, least: bool = False) -> DataFrame:
    """The n greatest values of each group in an array, greatest first (or the least, least first); nulls don't count."""
    return top_values_by(df.filter(F.col(x).isNotNull()), keys, x, x, n, name, least)


def top_values_by(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int, name: str, least: bool = False) -> DataFrame:
    """Values of ``x`` in the n rows of each group with the greatest (least) ``y``, ties by ``x``; rows whose y is null don't count.

    Groups are cut to n rows before the shuffle and after it, so no task holds one.
    """
    from gridloom.operators.windows import top_n_row_number

    order = [F.asc_nulls_last(c) if least else F.desc_nulls_first(c) for c in dict.fromkeys((y, x))]
    ranked = top_n_row_number(df.filter(F.col(y).isNotNull()).select(*keys, *dict.fromkeys((x, y))), keys, order, n, "_place")
    places = [F.first(F.when(F.col("_place") == i, F.struct(F.col(x).alias("v"))), ignorenulls=True) for i in range(1, n + 1)]
    return ranked.groupBy(*keys).agg(F.transform(F.array_compact(F.array(*places)), lambda s: s["v"]).alias(name))


def count_distinct(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """The number of distinct values of each group, not counting null, by rows of a value each.

    In one grouping with sketches, Spark would keep a state of every sketch for each distinct value of a group.
    """
    return df.select(*keys, x).distinct().groupBy(*keys).agg(F.count(x).alias(name))


def weighted_percentile(df: DataFrame, keys: Sequence[str], x: str, weight: str, p: float, name: str, error: float = 0.001) -> DataFrame:
    """A value of each group near its weighted percentile ``p``: within ``error`` of the least one that has this share at or below it, relative to it.

    Values fall in buckets whose bounds grow by a constant factor, so a group has a few thousand rows at most whatever
    its size. Null, NaN and weightless rows don't count.
    """
    v, step = F.col(x).cast("double"), math.log((1 + error) / (1 - error))
    bucket = F.when(v == 0, 0).otherwise(F.signum(v) * (F.ceil(F.ln(F.abs(v)) / step) + 10_000_000))
    counted = df.filter(F.col(x).isNotNull() & ~F.isnan(v) & (F.col(weight) > 0)).groupBy(*keys, bucket.alias("_b")).agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    group = Window.partitionBy(*keys)
    reached = counted.withColumn("_to", F.sum("_w").over(group.orderBy("_b"))).withColumn("_all", F.sum("_w").over(group))
    return reached.filter(F.col("_to") >= F.col("_all") * p).groupBy(*keys).agg(F.min_by((F.col("_low") + F.col("_high")) / 2, "_b").alias(name))


def reduce_agg(df: DataFrame, keys: Sequence[str], x: str, start: Column, step: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A fold of each group by ``step``, whose order must not matter: each task's rows first, then what these gave, by ``combine``.

    No list is longer than a task's rows or the number of tasks, however large a group is.
    """
    parts = df.select(*keys, F.spark_partition_id().alias("_task"), F.col(x).alias("_x")).groupBy(*keys, "_task").agg(F.aggregate(F.collect_list("_x"), start, step).alias("_part"))
    return parts.groupBy(*keys).agg(F.aggregate(F.collect_list("_part"), start, combine).alias(name))


def histogram(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """Counts of each value in a map, by key: counted in two steps, so that only distinct values meet."""
    counted = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "_n")))).alias(name))


def multimap_agg(df: DataFrame, keys: Sequence[str], k: str, v: str, name: str) -> DataFrame:
    """All values of each map key, in order, by key."""
    listed = df.filter(F.col(k).isNotNull()).groupBy(*keys, k).agg(F.array_sort(F.collect_list(v)).alias("_vs"))
    return listed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "_vs")))).alias(name))


def map_union_sum(df: DataFrame, keys: Sequence[str], m: str, name: str) -> DataFrame:
    """Maps added up by map key, by key."""
    summed = df.select(*keys, F.explode(m).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_s"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_s")))).alias(name))


def vector_sum(df: DataFrame, keys: Sequence[str], a: str, name: str) -> DataFrame:
    """Vectors added up element by element, by key; partial sums combine before the shuffle."""
    summed = df.select(*keys, F.posexplode(a).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_s"))
    return summed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias(name))


def most_frequent(df: DataFrame, keys: Sequence[str], x: str, n: int, name: str) -> DataFrame:
    """The n most frequent values with their counts in a map, by key; exact, ties by value."""
    from gridloom.operators.windows import top_n_row_number

    counted = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    top = top_n_row_number(counted, keys, [F.desc("_n"), x], n)
    return top.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "_n")))).alias(name))


#: Hashes of a value in a Bloom filter.
PROBES = 6


def _spots(x: Column, bits: int) -> list[tuple[Column, Column]]:
    """(word, bit) of each probe of a value in a bitmap of 64-bit words."""
    places = [F.pmod(F.xxhash64(x, lit(i)), lit(bits)) for i in range(PROBES)]
    return [(F.shiftright(at, 6), F.call_function("shiftleft", lit(1).cast("bigint"), at.bitwiseAND(lit(63)).cast("int"))) for at in places]


def bloom_filter_agg(df: DataFrame, keys: Sequence[str], x: str, name: str, expected: int = 100_000, bits: int | None = None) -> DataFrame:
    """A Bloom filter of the values of each group: a map from words of its bitmap, those that aren't 0, to their bits.

    Bits are set before the shuffle, a row a word, so a group never travels. ``bits`` is some nine for each of the
    ``expected`` distinct values unless given, which lets one in a hundred others pass. Nulls don't count.
    """
    spots = F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _spots(F.col(x), bits or filter_bits(expected))))
    words = df.filter(F.col(x).isNotNull()).select(*keys, F.explode(spots).alias("_s")).groupBy(*keys, F.col("_s.w").alias("_w")).agg(F.bit_or("_s.b").alias("_b"))
    return words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias(name))


def filter_bits(expected: int) -> int:
    return max(64, 9 * expected)


def might_contain(bloom: Column, x: Column, expected: int = 100_000, bits: int | None = None) -> Column:
    """False if the filter, made with the same ``expected`` or ``bits``, never saw the value; null if either is null."""
    held = [F.coalesce(F.try_element_at(bloom, w), lit(0).cast("bigint")).bitwiseAND(b) != 0 for w, b in _spots(x, bits or filter_bits(expected))]
    every = held[0]
    for one in held[1:]:
        every = every & one
    return F.when(bloom.isNotNull() & x.isNotNull(), every)
