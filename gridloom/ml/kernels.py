"""Kernels in built-in functions: they stay in the JVM, and Catalyst pushes, prunes and fuses them like any expression.

Vectors are arrays of float or double; arithmetic is in double.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

lit = F.lit


def constant(vector: Sequence[float]) -> Column:
    return F.array(*(lit(float(x)) for x in vector))


def total(a: Column) -> Column:
    return F.aggregate(a, lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda, a plain Column is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_scalar(a: Column, b: float) -> Column:
    return F.transform(a, lambda x: x + lit(float(b)))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, lit(0.0)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))


def softmax(a: Column) -> Column:
    """Shifted by the largest element, so that it doesn't overflow; linear in the vector."""
    shifted = lambda top: let(F.transform(a, lambda x: F.exp(x - top)), lambda raised: let(total(raised), lambda n: F.transform(raised, lambda x: x / n)))
    return let(F.array_max(a), shifted)


def argmax(a: Column) -> Column:
    """Place of the largest element from 0; the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def dot_product(a: Column, b: Column) -> Column:
    """The dot product as a vector of length 1."""
    return F.array(dot(a, b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """With 1e-8 added to the product of the norms, so that zero vectors give 0."""
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return dot(a, b) / (norm(a) * norm(b) + lit(1e-8))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def mat_mul(a: Column, weights: Sequence[Sequence[float]]) -> Column:
    """A row vector times constant weights (rows x columns): for small ones; large ones go through models.MatMul."""
    columns = list(zip(*weights, strict=True))
    return F.array(*(dot(a, constant(c)) for c in columns))


def min_max(x: Column, low: float, high: float) -> Column:
    return (x - lit(low)) / lit(high - low)


def dropout(a: Column, p: float, seed: int = 0) -> Column:
    """Elements set to 0 with probability p, without rescaling; the draw is by the seed and the element's value and place."""
    return F.transform(a, lambda x, i: F.when(F.pmod(F.xxhash64(x, i, lit(seed)), lit(1_000_000)) < int(p * 1_000_000), 0.0).otherwise(x))


def embedding(indexes: Column, table: Sequence[Sequence[float]]) -> Column:
    """Rows of a table, joined; an index that is out of range is an error."""
    rows = F.array(*(constant(r) for r in table))
    return F.flatten(F.transform(indexes, lambda i: F.element_at(rows, i + 1)))


def sequence_pooling(a: Column, width: int, kind: str) -> Column:
    """min, max or mean over vectors of ``width`` that stand one after the other; linear in the array."""
    how = {"min": F.array_min, "max": F.array_max, "mean": lambda c: total(c) / F.size(c)}[kind]
    vectors = F.transform(F.sequence(lit(0), (F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, lit(width)))
    return let(vectors, lambda vs: F.transform(F.sequence(lit(0), lit(width - 1)), lambda j: how(F.transform(vs, lambda v: F.get(v, j)))))


def position_encoding(a: Column, position: Column, width: int) -> Column:
    """Adds sines (even places) and cosines (odd places) of the row's position, given as a column."""
    angle = lambda i: position / F.pow(lit(10000.0), (i - i % 2) / lit(float(width)))
    return F.transform(a, lambda x, i: x + F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def batch_norm(df: DataFrame, column: str, gamma: Sequence[float], beta: Sequence[float], name: str, epsilon: float = 1e-5) -> DataFrame:
    """Each element less its mean over its standard deviation, both of the whole relation (variance over n - 1), scaled and shifted.

    The statistics are one row of as many numbers as the vector is long, so they are broadcast.
    """
    each = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    stats = each.agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("_stats"))
    scale, shift = constant(gamma), constant(beta)
    made = F.transform(column, lambda x, i: (x - F.get(F.col("_stats"), i)["m"]) / F.sqrt(F.get(F.col("_stats"), i)["v"] + lit(epsilon)) * F.get(scale, i) + F.get(shift, i))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, made).drop("_stats")


def svd_score(df: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, name: str) -> DataFrame:
    """User bias, item bias and dot product of their factors: tables (id, bias, factors); 0 where either is unknown."""
    u = users.select(F.col("id").alias("_u"), F.col("bias").alias("_ub"), F.col("factors").alias("_uf"))
    i = items.select(F.col("id").alias("_i"), F.col("bias").alias("_ib"), F.col("factors").alias("_if"))
    joined = df.join(u, F.col(user) == F.col("_u"), "left").join(i, F.col(item) == F.col("_i"), "left")
    return joined.withColumn(name, F.coalesce(F.col("_ub") + F.col("_ib") + dot(F.col("_uf"), F.col("_if")), lit(0.0))).drop("_u", "_ub", "_uf", "_i", "_ib", "_if")


def laplace(a: Column, epsilon: float, seed: int = 0) -> Column:
    """Laplace noise of scale 1 / epsilon on each element, by inverse transform of a seeded draw."""
    draw = lambda x, i: (F.pmod(F.xxhash64(x, i, lit(seed)), lit(1_000_003)) + 0.5) / 1_000_003 - 0.5
    return F.transform(a, lambda x, i: x - F.signum(draw(x, i)) * F.ln(1 - 2 * F.abs(draw(x, i))) / lit(float(epsilon)))


def counted(df: DataFrame, name: str):
    """The rows as they are, and an observation whose ``get['rows']`` is how many passed, once an action has run."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, F.count(lit(1)).alias("rows")), watch


# Conversions and encoders -------------------------------------------------------------------------------------------
def change_rating(r: Column) -> Column:
    return (r >= 3).cast("int")


def as_vector(x: Column) -> Column:
    return F.array(x.cast("float"))


def as_int_vector(x: Column) -> Column:
    return F.array(x.cast("int"))


def as_float_vector(a: Column) -> Column:
    return a.cast("array<float>")


def encode(x: Column, mapping: dict, missing: int = -1) -> Column:
    """A category's number, in a vector of length 1."""
    pairs = [lit(v) for pair in mapping.items() for v in pair]
    return F.array(F.coalesce(F.try_element_at(F.create_map(*pairs), x), lit(missing)))


def encode_all(a: Column, mapping: dict, missing: int = -1) -> Column:
    pairs = [lit(v) for pair in mapping.items() for v in pair]
    return F.transform(a, lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x), lit(missing)))


def one_hot(x: Column, vocabulary: Sequence[str]) -> Column:
    """1 for each category that a |-separated text names."""
    named = F.split(x, r"\|")
    return F.array(*(F.array_contains(named, v).cast("int") for v in vocabulary))


def token_frequency(a: Column, size: int) -> Column:
    return F.transform(F.sequence(lit(0), lit(size - 1)), lambda t: F.size(F.filter(a, lambda x: x == t)) / F.size(a))


def ratings_vector(m: Column, size: int) -> Column:
    """A map from ids (from 1) to ratings as a dense vector."""
    return F.transform(F.sequence(lit(1), lit(size)), lambda i: F.coalesce(F.try_element_at(m, i), lit(0)).cast("double"))


def multi_hot(a: Column, size: int) -> Column:
    """1 / k at each of k indexes."""
    return F.transform(F.sequence(lit(0), lit(size - 1)), lambda i: F.when(F.array_contains(a, i), 1 / F.size(a)).otherwise(0.0))


# Features of payments -----------------------------------------------------------------------------------------------
def is_weekday(day: Column) -> Column:
    return (F.weekday(day) < 5).cast("int")


def age(birth_year: Column, year: int) -> Column:
    return lit(year) - birth_year


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def date_to_timestamp(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.unix_seconds(F.to_timestamp(text, pattern))


def transaction_features(amount: Column, time: Column, top_amount: float) -> Column:
    """Amount over the greatest, weekday, day of the month, month, hour; all but the flag as fractions."""
    return F.array(amount / top_amount, is_weekday(time).cast("double"), F.dayofmonth(time) / 31, F.month(time) / 12, F.hour(time) / 24)


def customer_features(addresses: Column, flag: Column, birth_year: Column, country: Column, year: int) -> Column:
    return F.array(addresses.cast("double"), flag.cast("double"), age(birth_year, year) / 100, country.cast("double"))


def binary_class(a: Column, cut: float = 0.5) -> Column:
    return (F.element_at(a, 1) >= cut).cast("int")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math", "annotations", "Callable", "Sequence", "Column", "DataFrame", "F", "lit")]
