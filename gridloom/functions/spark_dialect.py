"""The lenient dialect: names of Spark SQL itself. Most are the session's own functions; others are small compositions.

Where this dialect gives null or wraps around instead of raising an error, the Column is made of the session's own
expression with its evaluation mode fixed, so that the result doesn't depend on the session's ANSI setting.
``make_date`` and ``bit_get`` raise as they do in the session; a cast raises where there is no value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.aggregates import might_contain
from gridloom.functions.catalyst import expression, option, unchecked

#: Names that Spark SQL has under the same name.
NATIVE = (
    "transform aggregate filter map_filter array array_contains array_intersect map_from_arrays concat lower upper isnull isnotnull array_min array_max get_json_object chr ascii lpad rpad "
    "substring overlay str_to_map left instr length substring_index md5 sha1 sha2 regexp_extract rlike split least greatest hash xxhash64 map startswith endswith contains trim ltrim rtrim translate replace "
    "find_in_set array_sort sort_array year make_date datediff last_day add_months date_add date_sub day dayofmonth dayofyear dayofweek quarter month hour rand random "
    "acos acosh asinh atanh sec csc sinh cosh cot atan2 log1p bin hex exp power round ceil floor hypot log2 log10 isnan bit_count bit_get shiftleft shiftright"
).split()


def _seeded(name: str) -> Callable[..., Column]:
    def build(seed: int, *columns: Column) -> Column:
        if seed != 42:
            raise ValueError("only seed 42 is available")
        return F.call_function(name, *columns)

    return build


def _scale(x: Column, scale: int) -> Column:
    return (x * F.lit(10**scale)).cast("bigint")


def _wrapping(name: str) -> Callable[[Column, Column], Column]:
    """Arithmetic of two numbers that wraps around."""
    return lambda a, b: expression(name, a, b, unchecked())


def _unix_time(text: Column | None = None, pattern: Column | str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds of a time, null if the text isn't one in that pattern; of now, if there is no text."""
    if text is None:
        return F.unix_timestamp()
    zone = SparkContext._active_spark_context._jvm.org.apache.spark.sql.classic.SparkSession.active().sessionState().conf().sessionLocalTimeZone()
    return expression("UnixTimestamp", text, F.lit(pattern), option(zone), False)


def _try_cast(x: Column, kind: str) -> Column:
    """A cast in which numbers wrap around, saturate or lose their fraction, and text may; null where there is no value."""
    context = SparkContext._active_spark_context._jvm
    zone = context.org.apache.spark.sql.classic.SparkSession.active().sessionState().conf().sessionLocalTimeZone()
    legacy = context.org.apache.spark.sql.catalyst.expressions.EvalMode.LEGACY()
    return expression("Cast", x, context.org.apache.spark.sql.types.DataType.fromDDL(kind), option(zone), legacy)


def _cast(x: Column, kind: str) -> Column:
    """As ``try_cast``, but an error where there is no value."""
    made = _try_cast(x, kind)
    return F.when(x.isNull() | made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), x.cast("string"))).cast(kind))


def _element_at(a: Column, at: Column) -> Column:
    return expression("ElementAt", a, at, option(None), False)


#: Names that are operators or compositions.
OWN: dict[str, Callable[..., Column]] = {
    "not": lambda x: ~x, "cast": _cast, "try_cast": _try_cast, "hash_with_seed": _seeded("hash"), "xxhash64_with_seed": _seeded("xxhash64"),
    "week_of_year": F.weekofyear, "doy": F.dayofyear, "dow": F.dayofweek, "get_timestamp": lambda s, pattern: F.try_to_timestamp(s, F.lit(pattern)), "unscaled_value": _scale,
    "make_decimal": lambda x, precision, scale: (x.cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal({precision},{scale})"), "decimal_round": lambda x, scale=0: F.round(x, scale),
    "add": _wrapping("Add"), "subtract": _wrapping("Subtract"), "multiply": _wrapping("Multiply"), "abs": lambda x: expression("Abs", x, False), "element_at": _element_at,
    "unix_timestamp": _unix_time, "to_unix_timestamp": _unix_time, "next_day": lambda x, day: expression("NextDay", x, day, False), "size": lambda x: expression("Size", x, True), "pmod": lambda a, b: F.when(b != 0, F.pmod(a, b)),
    "conv": lambda x, a, b: expression("Conv", x, F.lit(a), F.lit(b), False), "divide": lambda a, b: F.when(b != 0, a.cast("double") / b), "remainder": lambda a, b: F.when(b != 0, a % b),
    "unaryminus": lambda x: expression("UnaryMinus", x, False), "equalto": lambda a, b: a == b, "notequalto": lambda a, b: a != b, "lessthan": lambda a, b: a < b, "greaterthan": lambda a, b: a > b, "lessthanorequal": lambda a, b: a <= b,
    "greaterthanorequal": lambda a, b: a >= b, "equalnullsafe": lambda a, b: a.eqNullSafe(b), "between": lambda x, a, b: x.between(a, b), "in": lambda x, *a: x.isin(*a), "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
}
OWN |= {f"decimal_{name}": OWN[name] for name in ("equalto", "notequalto", "lessthan", "lessthanorequal", "greaterthan", "greaterthanorequal")}

OWN["might_contain"] = might_contain

#: Functions that take lambdas or plain values go through the API, not by name.
_API = {"transform": F.transform, "aggregate": F.aggregate, "filter": F.filter, "map_filter": F.map_filter, "sha2": F.sha2, "round": F.round, "regexp_extract": F.regexp_extract, "split": F.split, "rand": F.rand, "sort_array": F.sort_array, "array_sort": F.array_sort, "translate": F.translate, "map": F.create_map, "array": F.array}

SPARK: dict[str, Callable[..., Column]] = {name: _API.get(name) or (lambda *a, _n=name: F.call_function(_n, *a)) for name in NATIVE} | OWN


def spark_call(name: str, *arguments) -> Column:
    """The Column of a function of this dialect."""
    try:
        return SPARK[name.lower()](*arguments)
    except KeyError:
        raise ValueError(f"no such function: {name}") from None
