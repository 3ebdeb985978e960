"""The lenient dialect off the easy range: values that wrap around, give null or saturate; each has the same value in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables
from gridloom.functions import spark_call as s

QUERIES = {}
c, lit = F.col, F.lit
#: Zero, but not to the optimizer: results are worked out row by row.
_zero = lambda: F.pmod(c("o_orderkey"), lit(1).cast("bigint"))
_least, _most = lambda: lit(-(2**63)) + _zero(), lambda: lit(2**63 - 1) - _zero()
_day = lambda: c("o_orderdate").cast("date")
_text = lambda: F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
_small = lambda: (F.pmod("o_orderkey", lit(5)) + 1).cast("int")
_list = lambda: F.array("o_orderkey", "o_custkey", c("o_orderkey") + 1)
_map = lambda: F.create_map(lit("a"), c("o_orderkey"), lit("b"), c("o_custkey"))
_half = lambda: F.pmod("o_orderkey", lit(9)) / 10
_cents = lambda: c("o_totalprice").cast("decimal(12,2)")


def _orders(name: str, columns: dict[str, tuple]) -> None:
    """columns: output name -> (function that builds the Column, its value in SQL)."""

    def build(spark, sf_dir):
        return tables(spark, sf_dir).orders.select("o_orderkey", *(made().alias(n) for n, (made, _) in columns.items()))

    QUERIES[f"fn_lenient_{name}"] = (build, "SELECT o_orderkey, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in columns.items()) + " FROM orders")


_orders("overflow", {
    "added": (lambda: s("add", _most(), c("o_orderkey") + 1), "-9223372036854775807 - 1 + o_orderkey"),
    "taken": (lambda: s("subtract", _least(), c("o_orderkey") + 1), "9223372036854775807 - o_orderkey"),
    "times": (
        lambda: s("multiply", c("o_orderkey"), lit(2**62)),
        "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4611686018427387904 WHEN 2 THEN -9223372036854775807 - 1 ELSE -4611686018427387904 END",
    ),
    "minus": (lambda: s("unaryminus", _least()), "-9223372036854775807 - 1"),
    "absolute": (lambda: s("abs", _least()), "-9223372036854775807 - 1"),
    "int_added": (lambda: s("add", lit(2147483647) - _zero().cast("int"), _small()), "(-2147483648 + o_orderkey % 5)::INTEGER"),
    "byte_minus": (lambda: s("unaryminus", (lit(-128) + _zero()).cast("tinyint")), "(-128)::TINYINT"),
    "real_added": (lambda: s("add", c("o_totalprice"), lit(0.5)), "o_totalprice + 0.5"),
    "by_zero": (lambda: s("pmod", c("o_orderkey"), _zero()), "CAST(NULL AS BIGINT)"),
    "rest_by_zero": (lambda: s("remainder", c("o_orderkey"), _zero()), "CAST(NULL AS BIGINT)"),
})
_orders("dates", {
    "unix": (lambda: s("unix_timestamp", _text()), "epoch(o_orderdate)::BIGINT"),
    "unix_to": (lambda: s("to_unix_timestamp", F.substring(_text(), 1, 10), "yyyy-MM-dd"), "epoch(CAST(o_orderdate AS DATE))::BIGINT"),
    "unix_bad": (lambda: s("unix_timestamp", c("o_orderpriority")), "CAST(NULL AS BIGINT)"),
    "unix_short": (lambda: s("unix_timestamp", F.substring(_text(), 1, 10)), "CAST(NULL AS BIGINT)"),
    "monday": (lambda: s("next_day", _day(), lit("mo")), "CAST(o_orderdate AS DATE) + (8 - isodow(o_orderdate))::INTEGER"),
    "no_day": (lambda: s("next_day", _day(), c("o_orderpriority")), "CAST(NULL AS DATE)"),
    "read": (lambda: F.to_date(s("get_timestamp", _text(), "yyyy-MM-dd HH:mm:ss")), "CAST(o_orderdate AS DATE)"),
    "read_bad": (lambda: s("get_timestamp", c("o_orderpriority"), "yyyy-MM-dd"), "CAST(NULL AS TIMESTAMP)"),
    "earlier": (lambda: s("date_sub", _day(), lit(40)), "CAST(o_orderdate AS DATE) - 40"),
    "later": (lambda: s("date_add", _day(), lit(40)), "CAST(o_orderdate AS DATE) + 40"),
    "last": (lambda: s("last_day", _day()), "last_day(o_orderdate)"),
    "of_month": (lambda: s("dayofmonth", _day()), "day(o_orderdate)"),
    "of_week": (lambda: s("dayofweek", _day()), "dayofweek(o_orderdate) + 1"),
    "of_year": (lambda: s("dayofyear", _day()), "dayofyear(o_orderdate)"),
    "made": (lambda: s("make_date", F.year(_day()), F.month(_day()), lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)"),
})
_orders("arrays", {
    "past": (lambda: s("element_at", _list(), lit(4)), "CAST(NULL AS BIGINT)"),
    "before": (lambda: s("element_at", _list(), lit(-4)), "CAST(NULL AS BIGINT)"),
    "second_last": (lambda: s("element_at", _list(), lit(-2)), "o_custkey"),
    "of_map": (lambda: s("element_at", _map(), lit("b")), "o_custkey"),
    "no_key": (lambda: s("element_at", _map(), lit("z")), "CAST(NULL AS BIGINT)"),
    "has": (lambda: s("array_contains", _list(), c("o_custkey")), "true"),
    "ordered": (lambda: s("sort_array", _list()), "list_sort([o_orderkey, o_custkey, o_orderkey + 1])"),
    "folded": (lambda: s("aggregate", _list(), lit(0).cast("bigint"), lambda a, x: a + x), "2 * o_orderkey + o_custkey + 1"),
    "listed": (lambda: s("array", c("o_custkey"), c("o_orderkey")), "[o_custkey, o_orderkey]"),
    "mapped": (lambda: F.element_at(s("map_from_arrays", F.array(lit("x")), F.array("o_custkey")), "x"), "o_custkey"),
    "length": (lambda: s("size", _list()), "3"),
    "no_length": (lambda: s("size", F.when(_zero() != 0, _list())), "-1"),
})
_orders("strings", {
    "too_large": (lambda: s("conv", F.concat(lit("9223372036854775807"), c("o_orderkey").cast("string")), 10, 16), "'FFFFFFFFFFFFFFFF'"),
    "signed": (lambda: s("conv", (lit(2**63 - 1) - _zero()).cast("string"), 36, -10), "'-1'"),
    "negative": (lambda: s("conv", F.concat(lit("-"), F.hex("o_orderkey")), 16, -10), "'-' || o_orderkey"),
    "until_odd": (lambda: s("conv", F.concat(c("o_custkey").cast("string"), lit("xyz")), 10, 10), "o_custkey::VARCHAR"),
    "starts": (lambda: s("startswith", c("o_orderpriority"), lit("1-")), "starts_with(o_orderpriority, '1-')"),
    "ends": (lambda: s("endswith", c("o_orderpriority"), lit("LOW")), "ends_with(o_orderpriority, 'LOW')"),
    "place": (lambda: s("instr", c("o_orderpriority"), lit("-")), "instr(o_orderpriority, '-')"),
    "matches": (lambda: s("rlike", c("o_orderpriority"), lit("^[12]")), "regexp_matches(o_orderpriority, '^[12]')"),
    "part": (lambda: s("substring", c("o_orderpriority"), lit(3), lit(4)), "substr(o_orderpriority, 3, 4)"),
    "split_map": (
        lambda: F.element_at(s("str_to_map", F.concat(lit("a:"), c("o_orderstatus"), lit(",b:2")), lit(","), lit(":")), "a"), "o_orderstatus"),
    "is_null": (lambda: s("isnull", F.nullif("o_orderstatus", lit("F"))), "o_orderstatus = 'F'"),
    "is_not_null": (lambda: s("isnotnull", F.nullif("o_orderstatus", lit("F"))), "o_orderstatus <> 'F'"),
})
_orders("math", {
    **{n: (lambda n=n: F.round(s(n, _half() + 1), 8), f"round({n}((o_orderkey % 9) / 10 + 1), 8)") for n in ("acosh", "asinh", "cot")},
    "atanh_": (lambda: F.round(s("atanh", _half()), 8), "round(atanh((o_orderkey % 9) / 10), 8)"),
    "sinh_": (lambda: F.round(s("sinh", _half()), 8), "round((exp((o_orderkey % 9) / 10) - exp(-(o_orderkey % 9) / 10)) / 2, 8)"),
    "csc_": (lambda: F.round(s("csc", _half() + 1), 8), "round(1 / sin((o_orderkey % 9) / 10 + 1), 8)"),
    "sec_": (lambda: F.round(s("sec", _half()), 8), "round(1 / cos((o_orderkey % 9) / 10), 8)"),
    "log1p_": (lambda: F.round(s("log1p", _half()), 8), "round(ln(1 + (o_orderkey % 9) / 10), 8)"),
    "right_shift": (lambda: s("shiftright", c("o_orderkey"), lit(2)), "o_orderkey >> 2"),
    **{n: (lambda n=n: s(n, c("o_custkey"), c("o_orderkey")), f"o_custkey {o} o_orderkey") for n, o in (
        ("equalto", "="), ("notequalto", "<>"), ("lessthan", "<"), ("lessthanorequal", "<="), ("greaterthan", ">"), ("greaterthanorequal", ">="))},
    **{f"decimal_{n}": (lambda n=n: s(f"decimal_{n}", _cents(), lit("50000.25").cast("decimal(12,2)")), f"o_totalprice::DECIMAL(12,2) {o} 50000.25") for n, o in (
        ("equalto", "="), ("notequalto", "<>"), ("lessthan", "<"), ("lessthanorequal", "<="), ("greaterthan", ">"), ("greaterthanorequal", ">="))},
    "rounded": (lambda: s("decimal_round", _cents(), 1).cast("double"), "round(o_totalprice::DECIMAL(12,2), 1)::DOUBLE"),
    "cents": (lambda: s("make_decimal", c("o_orderkey"), 12, 2).cast("double"), "round(o_orderkey / 100, 2)"),
    "cast_": (lambda: s("cast", c("o_totalprice"), "string").cast("double"), "o_totalprice"),
})
_orders("casts", {
    "byte_wraps": (lambda: s("cast", (c("o_orderkey") * 0 + 1234567).cast("int"), "tinyint"), "(-121)::TINYINT"),
    "real_to_byte": (lambda: s("cast", c("o_totalprice") * 0 - 12345.67, "tinyint"), "(-57)::TINYINT"),
    "infinite": (lambda: s("cast", c("o_totalprice") * 0 + lit(float("inf")).cast("double") - 0.0, "bigint"), "9223372036854775807"),
    "no_number": (lambda: s("cast", F.when(c("o_orderkey") >= 0, lit(float("nan"))), "int"), "0::INTEGER"),
    "cut": (lambda: s("cast", c("o_totalprice"), "bigint"), "trunc(o_totalprice)::BIGINT"),
    "cut_text": (lambda: s("cast", F.concat(c("o_custkey").cast("string"), lit(".87")), "int"), "o_custkey::INTEGER"),
    "spaces": (lambda: s("cast", F.concat(lit("  "), c("o_custkey").cast("string"), lit(" ")), "bigint"), "o_custkey"),
    "year_only": (lambda: s("cast", F.date_format("o_orderdate", "yyyy"), "date"), "CAST(date_trunc('year', o_orderdate) AS DATE)"),
    "rest_of_date": (lambda: s("cast", F.concat(F.date_format("o_orderdate", "yyyy-M-d"), lit(" (BC)")), "date"), "CAST(o_orderdate AS DATE)"),
    "flag": (lambda: s("cast", F.when(c("o_orderstatus") == "F", "t").otherwise("no"), "boolean"), "o_orderstatus = 'F'"),
    "tried": (lambda: s("try_cast", c("o_orderpriority"), "int"), "CAST(NULL AS INTEGER)"),
    "none": (lambda: s("cast", F.nullif("o_custkey", c("o_custkey")).cast("string"), "int"), "CAST(NULL AS INTEGER)"),
})
_orders("names", {
    "transformed": (lambda: s("transform", _list(), lambda x: x * 2), "[o_orderkey * 2, o_custkey * 2, o_orderkey * 2 + 2]"),
    "filtered": (lambda: s("filter", _list(), lambda x: x > 100), "list_filter([o_orderkey, o_custkey, o_orderkey + 1], lambda x: x > 100)"),
    "some_keys": (lambda: F.map_keys(s("map_filter", _map(), lambda k, v: k == "b")), "['b']"),
    "common": (lambda: s("array_intersect", _list(), F.array("o_custkey")), "[o_custkey]"),
    "least_of": (lambda: s("array_min", _list()), "least(o_orderkey, o_custkey)"),
    "most_of": (lambda: s("array_max", _list()), "greatest(o_orderkey + 1, o_custkey)"),
    "in_order": (lambda: s("array_sort", _list()), "list_sort([o_orderkey, o_custkey, o_orderkey + 1])"),
    "paired": (lambda: F.element_at(s("map", c("o_orderstatus"), c("o_custkey")), c("o_orderstatus")), "o_custkey"),
    "joined": (lambda: s("concat", c("o_orderstatus"), lit("-"), c("o_orderpriority")), "o_orderstatus || '-' || o_orderpriority"),
    "letter": (lambda: s("chr", F.pmod("o_orderkey", lit(26)) + 65), "chr((o_orderkey % 26 + 65)::INTEGER)"),
    "filled": (lambda: s("lpad", c("o_orderstatus"), lit(4), lit("xy")), "lpad(o_orderstatus, 4, 'xy')"),
    "filled_after": (lambda: s("rpad", c("o_orderstatus"), lit(4), lit("xy")), "rpad(o_orderstatus, 4, 'xy')"),
    "extracted": (lambda: s("regexp_extract", c("o_orderpriority"), "([0-9])-([A-Z]+)", 2), "regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2)"),
    "pieces": (lambda: s("split", c("o_orderpriority"), "-"), "string_split(o_orderpriority, '-')"),
    "smaller": (lambda: s("least", F.nullif("o_custkey", lit(3)), c("o_orderkey")), "least(nullif(o_custkey, 3), o_orderkey)"),
    "has": (lambda: s("contains", c("o_orderpriority"), lit("OW")), "contains(o_orderpriority, 'OW')"),
    "trimmed": (lambda: s("trim", F.concat(lit(" "), "o_orderstatus", lit(" "))), "o_orderstatus"),
    "trimmed_before": (lambda: s("ltrim", F.concat(lit(" "), "o_orderstatus", lit(" "))), "o_orderstatus || ' '"),
    "trimmed_after": (lambda: s("rtrim", F.concat(lit(" "), "o_orderstatus", lit(" "))), "' ' || o_orderstatus"),
    "replaced": (lambda: s("replace", c("o_orderpriority"), lit("-"), lit("+")), "replace(o_orderpriority, '-', '+')"),
    **{n: (lambda n=n: s(n, _day()), f"{d}(o_orderdate)") for n, d in (("year", "year"), ("quarter", "quarter"), ("month", "month"), ("day", "day"), ("week_of_year", "weekofyear"), ("doy", "dayofyear"))},
    "hour_": (lambda: s("hour", c("o_orderdate")), "hour(o_orderdate)"),
    "drawn": (lambda: s("random", lit(3)).between(0, 1), "true"),
    **{f"{n}_": (lambda n=n: F.round(s(n, _half()), 8), f"round({n}((o_orderkey % 9) / 10), 8)") for n in ("acos", "cosh", "exp")},
    **{f"{n}_": (lambda n=n: F.round(s(n, _half() + 1), 8), f"round({n}((o_orderkey % 9) / 10 + 1), 8)") for n in ("log2", "log10")},
    "angle": (lambda: F.round(s("atan2", _half(), lit(2.0)), 8), "round(atan2((o_orderkey % 9) / 10, 2), 8)"),
    "raised": (lambda: F.round(s("power", _half(), lit(2.0)), 8), "round(pow((o_orderkey % 9) / 10, 2), 8)"),
    "rounded": (lambda: s("round", c("o_totalprice"), 0), "round(o_totalprice, 0)"),
    "up": (lambda: s("ceil", c("o_totalprice")), "ceil(o_totalprice)::BIGINT"),
    "down": (lambda: s("floor", c("o_totalprice")), "floor(o_totalprice)::BIGINT"),
    "hexed": (lambda: s("hex", c("o_orderkey")), "hex(o_orderkey)"),
    "ones": (lambda: s("bit_count", c("o_orderkey")), "bit_count(o_orderkey)::INTEGER"),
    "no_number": (lambda: s("isnan", c("o_totalprice")), "false"),
    "within": (lambda: s("between", c("o_custkey"), lit(10), lit(90)), "o_custkey BETWEEN 10 AND 90"),
    "among": (lambda: s("in", c("o_orderstatus"), "F", "P"), "o_orderstatus IN ('F', 'P')"),
    "both": (lambda: s("bitwise_and", c("o_orderkey"), c("o_custkey")), "o_orderkey & o_custkey"),
    "either": (lambda: s("bitwise_or", c("o_orderkey"), c("o_custkey")), "o_orderkey | o_custkey"),
    "one_of": (lambda: s("bitwise_xor", c("o_orderkey"), c("o_custkey")), "xor(o_orderkey, o_custkey)"),
})
