"""Edge cases of the strict dialect that differ from the session's own functions, and functions without SQL."""

import hashlib
import hmac
import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.functions import AGGREGATES, STRICT, SPARK, agg, strict, spark_call
from gridloom.functions.patterns import java_pattern
from gridloom.functions.udfs import incomplete_beta, incomplete_gamma, spooky_hash

lit = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: strict("greatest", lit(1), lit(None)), None), (lambda: strict("least", lit(3), lit(2)), 2), (lambda: strict("split_part", lit("a-b"), lit("-"), lit(3)), None), (lambda: strict("split_part", lit("a.b"), lit("."), lit(2)), "b"),
        (lambda: strict("substr", lit("abc"), lit(0)), ""), (lambda: strict("substr", lit("abc"), lit(-2), lit(1)), "b"), (lambda: strict("substr", lit("abc"), lit(-9)), ""), (lambda: strict("substr", lit("abc"), lit(9)), ""),
        (lambda: strict("array_min", F.array(lit(1), lit(None))), None), (lambda: strict("element_at", F.array(lit(1)), lit(5)), None), (lambda: strict("array_sum", F.array(lit(1), lit(None), lit(4))), 5),
        (lambda: strict("array_average", F.array(lit(1.0), lit(None), lit(4.0))), 2.5), (lambda: strict("find_first_index", F.array(lit(1)), lambda x: x > 3), None), (lambda: strict("strpos", lit("abcabc"), lit("c"), lit(2)), 6),
        (lambda: strict("strpos", lit("abc"), lit("z"), lit(1)), 0), (lambda: strict("strrpos", lit("abcb"), lit("b")), 4), (lambda: strict("strrpos", lit("abc"), lit("z")), 0), (lambda: strict("regexp_extract", lit("abc"), "z"), None),
        (lambda: strict("from_big_endian_64", F.unhex(lit("FFFFFFFFFFFFFFFF"))), -1), (lambda: strict("from_big_endian_32", F.unhex(lit("7FFFFFFF"))), 2**31 - 1), (lambda: strict("bit_count", lit(-1).cast("long"), lit(8)), 8),
        (lambda: strict("json_extract_scalar", lit('{"a":[1]}'), "$.a"), None), (lambda: strict("json_extract_scalar", lit("not json"), "$.a"), None), (lambda: strict("json_array_contains", lit('["x","y"]'), lit("y")), True),
        (lambda: strict("date_diff", "month", lit("2024-01-31").cast("timestamp"), lit("2024-02-29").cast("timestamp")), 1), (lambda: strict("url_extract_port", lit("http://h:81/x")), 81), (lambda: strict("url_extract_host", lit("nothing")), ""),
        (lambda: strict("truncate", lit(-1.79), lit(1)), -1.7), (lambda: strict("to_base", lit(255), 2), "11111111"), (lambda: strict("codepoint", lit("A")), 65), (lambda: strict("map_concat", F.create_map(lit(1), lit("a")), F.create_map(lit(1), lit("b"))), {1: "b"}),
        (lambda: strict("binomial_cdf", lit(5), lit(0.5), lit(5)), 1.0), (lambda: strict("cauchy_cdf", lit(0.0), lit(1.0), lit(0.0)), 0.5), (lambda: spark_call("divide", lit(1), lit(0)), None), (lambda: spark_call("greatest", lit(1), lit(None)), 1),
        (lambda: strict("try", "divide", lit(1), lit(0)), None), (lambda: strict("switch", lit(False), lit(1), lit(True), lit(2), lit(3)), 2), (lambda: strict("if", lit(False), lit(1)), None), (lambda: strict("and", lit(True), lit(None).cast("boolean"), lit(False)), False),
        (lambda: strict("or", lit(None).cast("boolean"), lit(True)), True), (lambda: strict("try_cast", lit("x"), "int"), None), (lambda: strict("array_position", F.array(lit(1), lit(2), lit(1)), lit(1), lit(2)), 3), (lambda: strict("ngrams", F.array(lit("a")), lit(3)), [["a"]]), (lambda: strict("array_normalize", F.array(lit(0.0)), lit(2.0)), [0.0]),
        (lambda: strict("combinations", F.array(lit(1), lit(2), lit(3)), 2), [[1, 2], [1, 3], [2, 3]]), (lambda: strict("replace", lit("aXbX"), lit("X")), "ab"), (lambda: strict("wilson_interval_upper", lit(4), lit(10), lit(0.0)), 0.4),
    ],
)
def test_value(spark, made, want):
    got = value(spark, made())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("made", [lambda: strict("greatest", lit(float("nan")), lit(1.0)), lambda: strict("codepoint", lit("ab")), lambda: strict("from_big_endian_32", F.unhex(lit("00"))), lambda: strict("subscript", F.array(lit(1)), lit(5)), lambda: strict("plus", lit(2**31 - 1), lit(1))])
def test_error(spark, made):
    with pytest.raises(Exception):  # noqa: B017
        value(spark, made())


def test_unknown_names():
    for call in (strict, spark_call, agg):
        with pytest.raises(ValueError):
            call("no_such_function")
    assert len(STRICT) > 230 and len(SPARK) > 130 and len(AGGREGATES) >= 50


def test_hashes(spark):
    data = b"some bytes"
    assert bytes(value(spark, strict("xxhash64", lit(data)))) == xxhash.xxh64(data, seed=0).digest()
    for name in ("md5", "sha1", "sha256", "sha512"):
        assert bytes(value(spark, strict(f"hmac_{name}", lit(data), lit(b"k")))) == hmac.new(b"k", data, name).digest()
        assert bytes(value(spark, strict(name, lit(data)))) == hashlib.new(name, data).digest()
    assert bytes(value(spark, strict("to_ieee754_64", lit(1.5)))) == struct.pack(">d", 1.5)
    assert spooky_hash(b"") == 0x232706FC6BF50919
    assert len({spooky_hash(bytes(n)) for n in range(0, 400, 7)}) == 58


def test_distributions():
    assert incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    assert incomplete_beta(1.0, 4.0, 0.3) == pytest.approx(1 - 0.7**4)
    assert incomplete_gamma(3.0, 2.0) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2))
    assert incomplete_gamma(1.0, 30.0) == pytest.approx(1 - math.exp(-30))


def test_normal_cdf(spark):
    assert value(spark, strict("normal_cdf", lit(0.0), lit(1.0), lit(1.96))) == pytest.approx(0.9750021)
    assert value(spark, strict("normal_cdf", lit(None).cast("double"), lit(1.0), lit(1.96))) is None


def test_date_patterns():
    assert java_pattern("%Y-%m-%dT%H:%i:%s") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        java_pattern("%X")


def test_aggregates_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, s string")
    row = df.agg(agg("kurtosis", F.col("x")).alias("k"), agg("skewness", F.col("x")).alias("w"), agg("array_agg", F.col("x")).alias("l"), agg("entropy", F.col("x") * 0).alias("e")).first()
    assert row.k is None and row.w is None and len(row.l) == 3 and row.e == 0


def test_user_functions(spark):
    import pandas as pd

    from gridloom.functions import registry

    def total(x: pd.Series) -> float:
        return float(x.sum())

    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    registry.register(spark, "own_total", registry.aggregate("double")(total))
    registry.register(spark, "own_twice", registry.vector("long")(twice))
    registry.register(spark, "own_next", registry.scalar("long")(lambda x: x + 1))
    assert spark.sql("SELECT own_total(own_next(own_twice(id))) AS v FROM range(4)").first().v == 16


def test_lenient_results_do_not_depend_on_the_ansi_setting(spark):
    from gridloom.functions import spark_call as s

    df = spark.sql("SELECT id, 9223372036854775807 AS most, 'abc' AS word, array(1, 2) AS a FROM range(1)")
    row = lambda: df.select(s("add", F.col("most"), F.col("id") + 1), s("unix_timestamp", F.col("word")), s("element_at", F.col("a"), F.lit(3)), s("next_day", F.current_date(), F.col("word"))).first()
    strict_row = row()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert row() == strict_row == (-(2**63), None, None, None)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("make", [
    lambda s: s("cast", F.col("word"), "int"), lambda s: s("make_date", F.lit(2020), F.lit(13), F.col("one")), lambda s: s("bit_get", F.col("one"), F.lit(64)), lambda s: s("element_at", F.array("one"), F.col("one") - 1),
])
def test_lenient_calls_that_stay_errors(spark, make):
    from gridloom.functions import spark_call as s

    with pytest.raises(Exception):  # noqa: B017
        spark.sql("SELECT 'abc' AS word, CAST(id + 1 AS INT) AS one FROM range(1)").select(make(s)).collect()


@pytest.mark.parametrize("pattern", ["", "q", "'open", "YYYY-Q"])
def test_patterns_that_are_errors(pattern):
    from gridloom.functions import patterns

    with pytest.raises(ValueError):
        patterns.runs(pattern)


def test_combinations_have_a_limit(spark):
    df = spark.sql("SELECT sequence(1L, 60L) AS a, sequence(1L, 5L) AS b FROM range(1)")
    assert len(df.select(strict("combinations", F.col("b"), 3).alias("v")).first().v) == 10
    with pytest.raises(Exception):  # noqa: B017
        df.select(strict("combinations", F.col("a"), 5)).collect()


def test_try_gives_null_for_any_error(spark):
    df = spark.sql("SELECT 'x' AS word, array(1) AS a, 0 AS zero FROM range(1)")
    failing = [F.col("word").cast("int"), F.lit(1) / F.col("zero"), F.element_at("a", F.lit(9)), F.raise_error(F.col("word")).cast("int"), strict("codepoint", F.concat("word", "word"))]
    assert list(df.select(*(strict("try", f).alias(f"c{i}") for i, f in enumerate(failing))).first()) == [None] * 5


@pytest.mark.parametrize("x, up, down", [(1.5, 2.0, 1.0), (-1.5, -1.0, -2.0), (-1e-17, 0.0, -1.0), (1e300, 1e300, 1e300), (float("inf"), float("inf"), float("inf")), (2.0, 2.0, 2.0)])
def test_whole_numbers_of_reals(spark, x, up, down):
    row = spark.createDataFrame([(x,)], "x double").select(strict("ceil", F.col("x")), strict("floor", F.col("x")), strict("sign", F.col("x"))).first()
    assert list(row) == [up, down, math.copysign(1, x)]
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(strict("ceil", F.col("x")), strict("sign", F.col("x"))).first()
    assert all(math.isnan(v) for v in nan)


@pytest.mark.parametrize("name", ["agg_top_values", "agg_by"])
def test_top_values_hold_no_group(spark, small, name):
    from gridloom import queries as registry

    plan = registry.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan


def test_top_values_of_nulls_and_few_rows(spark):
    from gridloom.functions import aggregates as A

    df = spark.createDataFrame([("a", 3, None), ("a", None, 5), ("a", 1, 7), ("b", None, None)], "k string, x int, y int")
    assert {r.k: r.v for r in A.top_values(df, ["k"], "x", 5, "v").collect()} == {"a": [3, 1]}
    assert {r.k: r.v for r in A.top_values_by(df, ["k"], "x", "y", 1, "v", least=True).collect()} == {"a": [None]}


def test_weighted_percentile_of_both_signs(spark):
    from gridloom.functions import aggregates as A

    rows = [("a", float(i - 50), 1 + i % 3) for i in range(101)] + [("b", 0.0, 1), ("b", None, 4), ("c", 2.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, w int")
    for p in (0.1, 0.5, 0.9):
        spread = sorted(x for k, x, w in rows if k == "a" for _ in range(w))
        want = spread[max(0, math.ceil(p * len(spread)) - 1)]
        got = {r.k: r.v for r in A.weighted_percentile(df, ["k"], "x", "w", p, "v").collect()}
        assert set(got) == {"a", "b"} and got["b"] == 0 and abs(got["a"] - want) <= 0.0011 * abs(want)


def test_array_runs_are_counted(spark):
    df = spark.createDataFrame([([3, 1, None, 3, None],), ([],), (None,)], "a array<int>")
    made = [tuple(r) for r in df.select(strict("array_frequency", F.col("a")), strict("array_duplicates", F.col("a"))).collect()]
    assert made == [({1: 1, 3: 2}, [None, 3]), ({}, []), (None, None)]


def test_sorted_aggregate_takes_a_direction_and_place_of_nulls_for_each_key(spark):
    from gridloom import operators as op

    df = spark.createDataFrame([("k", 1, None, "a"), ("k", 1, 2, "b"), ("k", 2, 1, "c"), ("k", None, 9, "d")], "k string, x int, y int, v string")
    made = op.sorted_aggregate(df, ["k"], "vs", "v", [F.desc_nulls_first("x"), F.asc_nulls_last("y")])
    assert made.first().vs == ["d", "c", "b", "a"]


@pytest.mark.parametrize("text, kind", [("1234567", "tinyint"), ("1a", "tinyint"), ("", "tinyint"), ("1,234", "int"), ("nan", "bigint"), ("1.2.3", "float"), ("12", "boolean"), ("tru", "boolean"), ("2015-031-8", "date")])
def test_lenient_casts_that_are_errors(spark, text, kind):
    from gridloom.functions import spark_call as s

    df = spark.createDataFrame([(text,)], "x string")
    with pytest.raises(Exception):  # noqa: B017
        df.select(s("cast", F.col("x"), kind)).collect()
    assert df.select(s("try_cast", F.col("x"), kind).alias("v")).first().v is None


@pytest.mark.parametrize("text, kind, value", [("1.23444", "tinyint", 1), (".2355", "tinyint", 0), ("-1.8", "tinyint", -1), ("+1", "tinyint", 1), ("1.", "tinyint", 1), ("0.", "tinyint", 0), (".", "tinyint", 0), ("1.7E308", "float", math.inf)])
def test_lenient_casts_of_text(spark, text, kind, value):
    from gridloom.functions import spark_call as s

    assert spark.createDataFrame([(text,)], "x string").select(s("cast", F.col("x"), kind).alias("v")).first().v == value


def test_an_empty_sketch_estimates_nothing(spark):
    assert spark.range(5).agg(F.hll_sketch_estimate(strict("empty_approx_set")).alias("v")).first().v == 0


@pytest.mark.parametrize("name", ["agg_sketches", "agg_approx_distinct_error"])
def test_sketches_are_not_kept_for_each_distinct_value(spark, small, name):
    from gridloom import queries as registry

    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    by_part = [line for line in plan.splitlines() if "l_partkey" in line.partition("keys=")[2].partition("functions=")[0]]
    assert by_part and all("functions=[]" in line for line in by_part)


def test_sketches_of_the_null_flag_and_of_a_flag_without_parts(spark, tmp_path):
    from gridloom import queries as registry

    rows = [(None, 1, 7, 5.0), (None, 2, 8, 5.0), ("A", 3, None, 6.0), ("R", 4, 9, None)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("agg_sketches", "agg_approx_distinct_error"):
        made = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
        assert {r[0] for r in made} == {None, "A", "R"} and len(made) == 3 and all(v is True for r in made for v in r[1:]), made
