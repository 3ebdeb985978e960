"""Scalar functions of the strict dialect by family, over columns of the driver's tables; each has the same value in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables
from gridloom.functions import strict as p
from gridloom.functions import spark_call as s

QUERIES = {}
c, lit = F.col, F.lit


def _family(name: str, table: str, key: str, rows: dict[str, tuple], source=None) -> None:
    """rows: output name -> (builder, DuckDB expression or None)."""

    def build(spark, sf_dir):
        df = getattr(tables(spark, sf_dir), table)
        df = source(df) if source else df
        return df.select(key, *(made().alias(n) for n, (made, _) in rows.items()))

    known = all(sql for _, sql in rows.values())
    QUERIES[f"fn_{name}"] = (build, f"SELECT {key}, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in rows.items()) + f" FROM {table}" if known else None)


_r = lambda made: lambda: F.round(made(), 8)
_unary = {n: (_r(lambda n=n: p(n, c("l_discount"))), f"round({n}(l_discount), 8)") for n in ("radians", "degrees", "exp", "cos", "cosh", "acos", "sin", "asin", "tan", "tanh", "atan", "sqrt", "cbrt")}
_family("math_unary", "lineitem", "l_orderkey", _unary)
_family("math", "lineitem", "l_orderkey", {
    "plus": (lambda: p("plus", c("l_quantity"), c("l_tax")), "l_quantity + l_tax"), "minus": (lambda: p("minus", c("l_quantity"), c("l_tax")), "l_quantity - l_tax"), "multiply": (lambda: p("multiply", c("l_quantity"), lit(3)), "l_quantity * 3"),
    "divide": (lambda: p("divide", c("l_extendedprice"), c("l_quantity")), "l_extendedprice / l_quantity"), "idiv": (lambda: p("integer_divide", c("l_partkey"), lit(7)).cast("long"), "l_partkey // 7"), "mod": (lambda: p("mod", c("l_partkey"), lit(7)), "l_partkey % 7"),
    "ceil": (lambda: p("ceil", c("l_extendedprice")), "ceil(l_extendedprice)"), "ceiling": (lambda: p("ceiling", c("l_tax")), "ceil(l_tax)"), "floor": (lambda: p("floor", c("l_extendedprice")), "floor(l_extendedprice)"), "abs": (lambda: p("abs", 25 - c("l_quantity")), "abs(25 - l_quantity)"),
    "negate": (lambda: p("negate", c("l_quantity")), "-l_quantity"), "round": (lambda: p("round", c("l_extendedprice"), 0), "round(l_extendedprice, 0)"), "power": (_r(lambda: p("power", c("l_tax"), lit(2.0))), "round(pow(l_tax, 2), 8)"),
    "ln": (_r(lambda: p("ln", c("l_quantity"))), "round(ln(l_quantity), 8)"), "log2": (_r(lambda: p("log2", c("l_quantity"))), "round(log2(l_quantity), 8)"), "log10": (_r(lambda: p("log10", c("l_quantity"))), "round(log10(l_quantity), 8)"),
    "clamp": (lambda: p("clamp", c("l_quantity"), lit(10.0), lit(20.0)), "least(greatest(l_quantity, 10), 20)"), "atan2": (_r(lambda: p("atan2", c("l_tax"), c("l_quantity"))), "round(atan2(l_tax, l_quantity), 8)"), "sign": (lambda: p("sign", c("l_quantity") - 25), "sign(l_quantity - 25)::DOUBLE"),
    "truncate": (lambda: p("truncate", 25.5 - c("l_quantity")), "trunc(25.5::DOUBLE - l_quantity)"), "bucket": (lambda: p("width_bucket", c("l_quantity"), lit(0.0), lit(60.0), lit(6)), "floor(l_quantity / 10)::BIGINT + 1"),
    "bins": (lambda: p("width_bucket", c("l_quantity"), F.array(lit(10.0), lit(20.0), lit(30.0))), "(CASE WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END)::BIGINT"),
    "finite": (lambda: p("is_finite", c("l_tax")), "isfinite(l_tax)"), "infinite": (lambda: p("is_infinite", c("l_tax")), "isinf(l_tax)"), "isnan": (lambda: p("is_nan", p("nan")), "true"), "consts": (_r(lambda: p("pi") + p("e")), "round(pi() + exp(1), 8)"),
    "to_base": (lambda: p("to_base", c("l_partkey"), 16), "lower(to_base(l_partkey, 16))"), "from_base": (lambda: p("from_base", F.lower(F.hex("l_partkey")), 16), "l_partkey"),
    "wilson": (_r(lambda: p("wilson_interval_lower", c("l_linenumber"), lit(10), lit(1.96))), "round((l_linenumber / 10 + 0.19208 - 1.96 * sqrt(l_linenumber / 10 * (1 - l_linenumber / 10) / 10 + 0.009604)) / 1.38416, 8)"),
})
_family("compare", "customer", "c_custkey", {
    **{n: (lambda n=n: p(n, c("c_nationkey"), lit(12)), f"c_nationkey {o} 12") for n, o in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("gt", ">"), ("lte", "<="), ("gte", ">="))},
    "distinct_from": (lambda: p("distinct_from", F.nullif("c_nationkey", lit(3)), lit(None)), "nullif(c_nationkey, 3) IS DISTINCT FROM NULL"), "between_": (lambda: p("between", c("c_nationkey"), lit(5), lit(9)), "c_nationkey BETWEEN 5 AND 9"),
    "in_": (lambda: p("in", c("c_nationkey"), 1, 2, 3), "c_nationkey IN (1, 2, 3)"), "is_null": (lambda: p("is_null", F.nullif("c_nationkey", lit(3))), "nullif(c_nationkey, 3) IS NULL"), "not_": (lambda: p("not", c("c_nationkey") == 1), "NOT c_nationkey = 1"),
    "greatest_": (lambda: p("greatest", c("c_nationkey"), F.nullif(F.pmod("c_custkey", lit(20)), lit(7))), "CASE WHEN c_custkey % 20 <> 7 THEN greatest(c_nationkey, c_custkey % 20) END"),
    "least_": (lambda: p("least", c("c_nationkey"), F.nullif(F.pmod("c_custkey", lit(20)), lit(7))), "CASE WHEN c_custkey % 20 <> 7 THEN least(c_nationkey, c_custkey % 20) END"),
})
_family("strings", "part", "p_partkey", {
    "chr": (lambda: p("chr", c("p_size") + 64), "chr(p_size + 64)"), "codepoint": (lambda: p("codepoint", F.substring("p_type", 1, 1)), "ascii(substr(p_type, 1, 1))"), "lev": (lambda: p("levenshtein_distance", c("p_type"), c("p_brand")), "levenshtein(p_type, p_brand)"),
    "length": (lambda: p("length", c("p_name")), "length(p_name)"), "starts": (lambda: p("starts_with", c("p_type"), lit("S")), "starts_with(p_type, 'S')"), "ends": (lambda: p("ends_with", c("p_type"), lit("L")), "ends_with(p_type, 'L')"),
    "sub0": (lambda: p("substr", c("p_type"), lit(0), lit(2)), "''"), "sub2": (lambda: p("substr", c("p_type"), lit(2), lit(3)), "substr(p_type, 2, 3)"), "subneg": (lambda: p("substr", c("p_type"), lit(-3)), "right(p_type, 3)"),
    "part1": (lambda: p("split_part", c("p_brand"), lit("#"), lit(2)), "split_part(p_brand, '#', 2)"), "part9": (lambda: p("split_part", c("p_brand"), lit("#"), lit(9)), "CAST(NULL AS VARCHAR)"), "trim": (lambda: p("trim", F.concat(lit("  "), "p_type", lit(" "))), "p_type"),
    "ltrim": (lambda: p("ltrim", F.concat(lit("  "), "p_type")), "p_type"), "rtrim": (lambda: p("rtrim", F.concat("p_type", lit("  "))), "p_type"), "lpad": (lambda: p("lpad", c("p_type"), 10, "xy"), "lpad(p_type, 10, 'xy')"), "rpad": (lambda: p("rpad", c("p_type"), 4, "z"), "rpad(p_type, 4, 'z')"),
    "like_": (lambda: p("like", c("p_type"), lit("%A%")), "p_type LIKE '%A%'"), "rx_replace": (lambda: p("regexp_replace", c("p_brand"), "[0-9]+", "N"), "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"), "lower": (lambda: p("lower", c("p_type")), "lower(p_type)"),
    "upper": (lambda: p("upper", c("p_name")), "upper(p_name)"), "split": (lambda: p("split", F.concat("p_type", lit("."), "p_brand"), lit(".")), "string_split(p_type || '.' || p_brand, '.')"), "concat": (lambda: p("concat", c("p_type"), lit("-"), c("p_brand")), "p_type || '-' || p_brand"),
    "replace": (lambda: p("replace", c("p_type"), lit("A"), lit("aa")), "replace(p_type, 'A', 'aa')"), "reverse": (lambda: p("reverse", c("p_type")), "reverse(p_type)"), "rx_extract": (lambda: p("regexp_extract", c("p_brand"), "#([1-4])", 1), "nullif(regexp_extract(p_brand, '#([1-4])', 1), '')"),
    "rx_all": (lambda: p("regexp_extract_all", c("p_type"), "[AEIOU]"), "regexp_extract_all(p_type, '[AEIOU]')"), "rx_like": (lambda: p("regexp_like", c("p_type"), lit("^[PS]")), "regexp_matches(p_type, '^[PS]')"),
    "strpos": (lambda: p("strpos", c("p_type"), lit("A")), "strpos(p_type, 'A')"), "strpos2": (lambda: p("strpos", F.concat("p_type", lit("-"), "p_type"), lit("-"), lit(1)), "length(p_type) + 1"), "strrpos": (lambda: p("strrpos", F.concat("p_type", lit("-"), "p_type"), lit("-")), "length(p_type) + 1"),
    "utf8": (lambda: p("from_utf8", p("to_utf8", c("p_name"))), "p_name"),
})
_lists = lambda df: df.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.pmod("o_orderkey", lit(7)))).alias("a"), F.array_sort(F.collect_set(F.pmod("o_orderkey", lit(5)))).alias("b"))
_LISTS = "(SELECT o_custkey, list_sort(list(o_orderkey % 7)) AS a, list_sort(list(DISTINCT o_orderkey % 5)) AS b FROM orders GROUP BY o_custkey)"
_arrays = {
    "lo": (lambda: p("array_min", c("a")), "list_min(a)"), "hi": (lambda: p("array_max", c("a")), "list_max(a)"), "joined": (lambda: p("array_join", c("a"), ","), "array_to_string(a, ',')"), "dups": (lambda: p("array_has_duplicates", c("a")), "len(list_distinct(a)) < len(a)"),
    "trimmed": (lambda: p("trim_array", c("a"), lit(1)), "a[1:len(a) - 1]"), "no_nulls": (lambda: p("remove_nulls", F.transform("a", lambda x: F.nullif(x, lit(3)))), "list_filter(a, lambda x: x <> 3)"), "united": (lambda: F.array_sort(p("array_union", c("a"), c("b"))), "list_sort(list_distinct(list_concat(a, b)))"),
    "removed": (lambda: p("array_remove", c("a"), 2), "list_filter(a, lambda x: x <> 2)"), "all_": (lambda: p("all_match", c("a"), lambda x: x >= 0), "true"), "any_": (lambda: p("any_match", c("a"), lambda x: x > 5), "len(list_filter(a, lambda x: x > 5)) > 0"),
    "none_": (lambda: p("none_match", c("a"), lambda x: x > 5), "len(list_filter(a, lambda x: x > 5)) = 0"), "found": (lambda: p("find_first", c("a"), lambda x: x > 2), "list_filter(a, lambda x: x > 2)[1]"), "at": (lambda: p("find_first_index", c("a"), lambda x: x > 2), "nullif(list_position(list_transform(a, lambda x: x > 2), true), 0)"),
    "uniq": (lambda: F.array_sort(p("array_distinct", c("a"))), "list_sort(list_distinct(a))"), "duplicated": (lambda: p("array_duplicates", c("a")), "list_sort(list_filter(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) > 1))"), "common": (lambda: F.array_sort(p("array_intersect", c("a"), c("b"))), "list_sort(list_intersect(a, b))"),
    "contains": (lambda: p("contains", c("a"), 4), "list_contains(a, 4)"), "except_": (lambda: F.array_sort(p("array_except", c("a"), c("b"))), "list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))"), "overlap": (lambda: p("arrays_overlap", c("a"), c("b")), "list_has_any(a, b)"),
    "sliced": (lambda: p("slice", c("a"), 2, 2), "a[2:3]"), "zipped": (lambda: F.transform(p("zip_with", c("b"), c("b"), lambda x, y: x * 10 + y), lambda z: z), "list_transform(b, lambda x: x * 11)"), "pos": (lambda: p("array_position", c("a"), 3), "coalesce(list_position(a, 3), 0)"),
    "pos2": (lambda: p("array_position", c("a"), lit(3), lit(2)), "CASE WHEN len(list_filter(a, lambda x: x = 3)) > 1 THEN list_position(a, 3) + 1 ELSE 0 END"), "sorted_": (lambda: p("array_sort", c("b")), "list_sort(b)"), "sorted_desc": (lambda: p("array_sort_desc", c("a")), "list_reverse_sort(a)"),
    "total": (lambda: p("array_sum", c("a")), "list_sum(a)::BIGINT"), "mean": (lambda: F.round(p("array_average", c("a")), 8), "round(list_avg(a), 8)"), "repeated": (lambda: p("repeat", c("o_custkey"), 2), "[o_custkey, o_custkey]"), "seq": (lambda: p("sequence", lit(1), lit(9), lit(2)), "range(1, 10, 2)"),
    "flat": (lambda: p("flatten", F.array("a", "b")), "list_concat(a, b)"), "grams": (lambda: p("ngrams", c("a"), lit(2)), "CASE WHEN len(a) < 2 THEN [a] ELSE list_transform(range(1, len(a)), lambda i: a[i:i + 1]) END"), "size": (lambda: p("cardinality", c("a")), "len(a)"),
    "mapped": (lambda: p("transform", c("a"), lambda x: x * 2), "list_transform(a, lambda x: x * 2)"), "kept": (lambda: p("filter", c("a"), lambda x: x > 2), "list_filter(a, lambda x: x > 2)"), "folded": (lambda: p("reduce", c("a"), lit(0).cast("long"), lambda acc, x: acc + x), "list_sum(a)::BIGINT"),
    "elem": (lambda: p("element_at", c("a"), lit(99)), "a[99]"), "elem1": (lambda: p("subscript", c("a"), lit(1)), "a[1]"), "freq": (lambda: F.map_values(p("array_frequency", c("a"))), "list_transform(list_sort(list_distinct(a)), lambda x: len(list_filter(a, lambda y: y = x)))"),
    "joined_arrays": (lambda: p("concat", c("a"), c("b")), "list_concat(a, b)"), "norm": (lambda: F.transform(p("array_normalize", F.array(lit(3.0), lit(4.0)), lit(2.0)), lambda x: F.round(x, 8)), "[0.6::DOUBLE, 0.8::DOUBLE]"),
}
_family("arrays", "orders", "o_custkey", _arrays, _lists)
QUERIES["fn_arrays"] = (QUERIES["fn_arrays"][0], QUERIES["fn_arrays"][1].removesuffix(" FROM orders") + f" FROM {_LISTS}")
QUERIES["fn_combinations"] = (lambda spark, sf_dir: _lists(tables(spark, sf_dir).orders).select("o_custkey", F.size(p("combinations", c("b"), 2)).alias("n")), f"SELECT o_custkey, (len(b) * (len(b) - 1)) // 2 AS n FROM {_LISTS}")
_maps = lambda df: df.select("o_orderkey", F.create_map(lit("a"), c("o_orderkey"), lit("b"), c("o_custkey")).alias("m"), F.create_map(lit("b"), lit(1).cast("long"), lit("z"), lit(2).cast("long")).alias("m2"))
_family("maps", "orders", "o_orderkey", {
    "filtered": (lambda: F.map_keys(p("map_filter", c("m"), lambda k, v: k > "a")), "['b']"), "keys": (lambda: F.map_keys(p("transform_keys", c("m"), lambda k, v: F.upper(k))), "['A', 'B']"), "vals": (lambda: F.map_values(p("transform_values", c("m"), lambda k, v: v + 1)), "[o_orderkey + 1, o_custkey + 1]"),
    "made": (lambda: F.element_at(p("map", F.array(lit("q")), F.array("o_orderkey")), "q"), "o_orderkey"), "entries": (lambda: F.size(p("map_entries", c("m"))), "2"), "back": (lambda: F.element_at(p("map_from_entries", F.map_entries("m")), "b"), "o_custkey"), "ks": (lambda: p("map_keys", c("m")), "['a', 'b']"),
    "vs": (lambda: p("map_values", c("m")), "[o_orderkey, o_custkey]"), "zipped": (lambda: F.element_at(p("map_zip_with", c("m"), c("m2"), lambda k, x, y: F.coalesce(x, lit(0)) + F.coalesce(y, lit(0))), "b"), "o_custkey + 1"), "merged": (lambda: F.element_at(p("map_concat", c("m"), c("m2")), "b"), "1"),
    "all_keys": (lambda: p("all_keys_match", c("m"), lambda k: k < "c"), "true"), "any_keys": (lambda: p("any_keys_match", c("m"), lambda k: k == "b"), "true"), "no_keys": (lambda: p("no_keys_match", c("m"), lambda k: k == "q"), "true"), "any_values": (lambda: p("any_values_match", c("m"), lambda v: v > 1000), "o_orderkey > 1000 OR o_custkey > 1000"),
    "no_values": (lambda: p("no_values_match", c("m"), lambda v: v > 1000), "NOT (o_orderkey > 1000 OR o_custkey > 1000)"), "missing": (lambda: p("element_at", c("m"), lit("q")), "CAST(NULL AS BIGINT)"), "size": (lambda: p("cardinality", c("m")), "2"),
    "multi": (lambda: F.element_at(p("multimap_from_entries", F.array(F.struct(lit("x").alias("k"), c("o_orderkey").alias("v")), F.struct(lit("x").alias("k"), lit(1).cast("long").alias("v")))), "x"), "[o_orderkey, 1]"), "split_map": (lambda: F.element_at(p("split_to_map", lit("a=1;b=2"), lit(";"), lit("=")), "b"), "'2'"),
    "cosine": (lambda: F.round(p("cosine_similarity", F.create_map(lit("a"), lit(1.0), lit("b"), lit(2.0)), F.create_map(lit("a"), lit(3.0), lit("c"), lit(1.0))), 8), "round(3 / sqrt(50), 8)"),
}, _maps)
_family("bits", "orders", "o_orderkey", {
    "a": (lambda: p("bitwise_and", c("o_orderkey"), c("o_custkey")), "o_orderkey & o_custkey"), "o": (lambda: p("bitwise_or", c("o_orderkey"), c("o_custkey")), "o_orderkey | o_custkey"), "x": (lambda: p("bitwise_xor", c("o_orderkey"), c("o_custkey")), "xor(o_orderkey, o_custkey)"),
    "n": (lambda: p("bitwise_not", c("o_orderkey")), "~o_orderkey"), "cnt": (lambda: p("bit_count", c("o_orderkey"), lit(64)), "bit_count(o_orderkey)"), "cnt8": (lambda: p("bit_count", c("o_orderkey"), lit(8)), "bit_count(o_orderkey & 255)"), "l": (lambda: p("bitwise_left_shift", c("o_orderkey"), lit(3)), "o_orderkey * 8"),
    "r": (lambda: p("bitwise_right_shift", c("o_orderkey"), lit(2)), "o_orderkey >> 2"), "ra": (lambda: p("bitwise_arithmetic_shift_right", -c("o_orderkey"), lit(1)), "floor(-o_orderkey / 2)::BIGINT"), "ra2": (lambda: p("bitwise_right_shift_arithmetic", c("o_orderkey"), lit(1)), "o_orderkey >> 1"),
    "rl": (lambda: p("bitwise_logical_shift_right", c("o_orderkey"), lit(1), lit(8)), "(o_orderkey & 255) >> 1"), "sl": (lambda: p("bitwise_shift_left", c("o_orderkey"), lit(1), lit(8)), "(o_orderkey * 2) & 255"), "past": (lambda: p("bitwise_left_shift", c("o_orderkey"), lit(64)), "0"),
})
_family("dates", "orders", "o_orderkey", {
    **{n: (lambda n=n: p(n, c("o_orderdate")), f"{d}(o_orderdate)") for n, d in (("year", "year"), ("quarter", "quarter"), ("month", "month"), ("week", "weekofyear"), ("day", "day"), ("dow", "isodow"), ("doy", "dayofyear"), ("yow", "isoyear"), ("hour", "hour"), ("minute", "minute"), ("second", "second"))},
    "day_of_month": (lambda: p("day_of_month", c("o_orderdate")), "day(o_orderdate)"), "day_of_week": (lambda: p("day_of_week", c("o_orderdate")), "isodow(o_orderdate)"), "day_of_year": (lambda: p("day_of_year", c("o_orderdate")), "dayofyear(o_orderdate)"), "week_of_year": (lambda: p("week_of_year", c("o_orderdate")), "weekofyear(o_orderdate)"),
    "year_of_week": (lambda: p("year_of_week", c("o_orderdate")), "isoyear(o_orderdate)"), "ms": (lambda: p("millisecond", c("o_orderdate")), "0"), "ux": (lambda: p("to_unixtime", c("o_orderdate")), "epoch(o_orderdate)::DOUBLE"), "back": (lambda: p("from_unixtime", F.unix_seconds(c("o_orderdate").cast("timestamp"))) == c("o_orderdate").cast("timestamp"), "true"),
    "d": (lambda: p("date", c("o_orderdate")), "CAST(o_orderdate AS DATE)"), "last": (lambda: p("last_day_of_month", c("o_orderdate")), "last_day(o_orderdate)"), "added": (lambda: F.to_date(p("date_add", "month", lit(1), c("o_orderdate"))), "CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)"),
    "added_d": (lambda: F.to_date(p("date_add", "day", lit(10), c("o_orderdate"))), "CAST(o_orderdate + INTERVAL 10 DAY AS DATE)"), "diff": (lambda: p("date_diff", "day", F.to_timestamp(lit("1995-01-01")), c("o_orderdate")), "date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)"),
    "diff_h": (lambda: p("date_diff", "hour", F.to_timestamp(lit("1995-01-01")), c("o_orderdate")), "date_diff('hour', TIMESTAMP '1995-01-01', o_orderdate)"), "fmt": (lambda: p("date_format", c("o_orderdate"), "%Y-%m-%d %H:%i"), "strftime(o_orderdate, '%Y-%m-%d %H:%M')"),
    "joda": (lambda: p("format_datetime", c("o_orderdate"), "yyyy/MM"), "strftime(o_orderdate, '%Y/%m')"), "parsed": (lambda: F.to_date(p("date_parse", F.date_format("o_orderdate", "yyyy-MM-dd"), "%Y-%m-%d")), "CAST(o_orderdate AS DATE)"), "parsed2": (lambda: F.to_date(p("parse_datetime", F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")), "CAST(o_orderdate AS DATE)"),
    "trunc_m": (lambda: F.to_date(p("date_trunc", "month", c("o_orderdate"))), "CAST(date_trunc('month', o_orderdate) AS DATE)"), "tz_h": (lambda: p("timezone_hour", c("o_orderdate")), "0"), "tz_m": (lambda: p("timezone_minute", c("o_orderdate")), "0"),
})
_family("json", "events", "event_id", {
    "k": (lambda: p("json_extract_scalar", c("props"), "$.k"), "json_extract_string(props, '$.k')"), "none": (lambda: p("json_extract_scalar", c("props"), "$.q"), "CAST(NULL AS VARCHAR)"), "raw": (lambda: p("json_extract", c("props"), "$.k"), "CAST(json_extract(props, '$.k') AS VARCHAR)"),
    "scalar": (lambda: p("is_json_scalar", c("props")), "false"), "scalar2": (lambda: p("is_json_scalar", lit("3")), "true"), "len": (lambda: p("json_array_length", lit("[1,2,3]")), "3"), "has": (lambda: p("json_array_contains", lit("[1,2,3]"), lit(2)), "true"), "has_not": (lambda: p("json_array_contains", lit("[1,2,3]"), lit(7)), "false"),
    "size": (lambda: p("json_size", c("props"), "$"), "len(json_keys(props))"), "size0": (lambda: p("json_size", c("props"), "$.k"), "0"), "fmt": (lambda: p("json_format", p("json_parse", lit("[1, 2]"))), "'[1,2]'"),
})
_U = "http://host.example:8080/path/x?q=1&r=two#frag"
_family("urls", "nation", "n_nationkey", {
    "host": (lambda: p("url_extract_host", lit(_U)), "'host.example'"), "frag": (lambda: p("url_extract_fragment", lit(_U)), "'frag'"), "path": (lambda: p("url_extract_path", lit(_U)), "'/path/x'"), "proto": (lambda: p("url_extract_protocol", lit(_U)), "'http'"), "query": (lambda: p("url_extract_query", lit(_U)), "'q=1&r=two'"),
    "param": (lambda: p("url_extract_parameter", lit(_U), lit("r")), "'two'"), "port": (lambda: p("url_extract_port", lit(_U)), "8080"), "noport": (lambda: p("url_extract_port", lit("http://h/p")), "CAST(NULL AS BIGINT)"), "enc": (lambda: p("url_encode", F.concat("n_name", lit(" &"))), "n_name || '+%26'"), "dec": (lambda: p("url_decode", lit("a+b%26")), "'a b&'"),
})
QUERIES["fn_url_pages"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).pages.select("page_id", p("url_extract_protocol", c("url")).alias("protocol"), p("url_extract_host", c("url")).alias("host")),
    "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages",
)
_b = lambda: F.encode("n_name", "UTF-8")
_family("binary", "nation", "n_nationkey", {
    "md5": (lambda: p("to_hex", p("md5", _b())), "upper(md5(n_name))"), "sha1": (lambda: p("to_hex", p("sha1", _b())), "upper(sha1(n_name))"), "sha256": (lambda: p("to_hex", p("sha256", _b())), "upper(sha256(n_name))"), "hex": (lambda: p("to_hex", _b()), "hex(n_name)"), "unhex": (lambda: p("from_hex", lit("4142")).cast("string"), "'AB'"),
    "b64": (lambda: p("to_base64", _b()), "to_base64(encode(n_name))"), "unb64": (lambda: p("from_base64", F.base64(_b())).cast("string"), "n_name"), "b64url": (lambda: p("to_base64url", F.unhex(lit("fbff"))), "'-_8='"), "unb64url": (lambda: F.hex(p("from_base64url", lit("-_8="))), "'FBFF'"),
    "be32": (lambda: F.hex(p("to_big_endian_32", c("n_nationkey"))), "lpad(hex(n_nationkey::BIGINT), 8, '0')"), "be64": (lambda: F.hex(p("to_big_endian_64", c("n_nationkey"))), "lpad(hex(n_nationkey::BIGINT), 16, '0')"), "from32": (lambda: p("from_big_endian_32", F.unhex(lit("FFFFFFFE"))), "-2"), "from64": (lambda: p("from_big_endian_64", F.unhex(lit("000000000000002A"))), "42"),
})
_family("udfs", "nation", "n_nationkey", {
    **{n: (lambda n=n: F.hex(p(n, _b(), F.encode(lit("key"), "UTF-8"))), None) for n in ("hmac_sha512",)}, **{n: (lambda n=n: F.hex(p(n, _b())), None) for n in ("xxhash64", "spooky_hash_v2_32", "spooky_hash_v2_64")}, "sha512": (lambda: F.hex(p("sha512", _b())), None),
    "crc": (lambda: p("crc32", _b()), None), "f64": (lambda: F.hex(p("to_ieee754_64", c("n_nationkey") / 3)), None), "f32": (lambda: F.hex(p("to_ieee754_32", c("n_nationkey") / 3)), None),
})
_x = lambda: c("l_quantity") / 10
_family("probability", "lineitem", "l_orderkey", {
    "cauchy": (_r(lambda: p("cauchy_cdf", lit(1.0), lit(2.0), _x())), "round(0.5 + atan((l_quantity / 10 - 1) / 2) / pi(), 8)"), "laplace": (_r(lambda: p("laplace_cdf", lit(2.0), lit(1.0), _x())), "round(CASE WHEN l_quantity / 10 < 2 THEN 0.5 * exp(l_quantity / 10 - 2) ELSE 1 - 0.5 * exp(2 - l_quantity / 10) END, 8)"),
    "weibull": (_r(lambda: p("weibull_cdf", lit(1.5), lit(2.0), _x())), "round(1 - exp(-pow(l_quantity / 20, 1.5)), 8)"), "expo": (_r(lambda: p("gamma_cdf", lit(1.0), lit(2.0), _x())), "round(1 - exp(-l_quantity / 20), 8)"), "chi2": (_r(lambda: p("chi_squared_cdf", lit(2.0), _x())), "round(1 - exp(-l_quantity / 20), 8)"),
    "beta": (_r(lambda: p("beta_cdf", lit(2.0), lit(1.0), _x() / 5)), "round(pow(l_quantity / 50, 2), 8)"), "poisson": (_r(lambda: p("poisson_cdf", _x(), lit(1))), "round(exp(-l_quantity / 10) * (1 + l_quantity / 10), 8)"), "binomial": (_r(lambda: p("binomial_cdf", lit(2), _x() / 5, lit(1))), "round(1 - pow(l_quantity / 50, 2), 8)"),
    "f": (_r(lambda: p("f_cdf", lit(2.0), lit(2.0), _x())), "round((l_quantity / 10) / (1 + l_quantity / 10), 8)"), "inverse_beta": (_r(lambda: p("inverse_beta_cdf", lit(2.0), lit(1.0), _x() / 5)), "round(sqrt(l_quantity / 50), 8)"),
})
_family("normal_cdf", "lineitem", "l_orderkey", {  # the SQL adds up the density by Simpson's rule
    "v": (_r(lambda: p("normal_cdf", lit(2.0), lit(1.5), _x())),
          "round(0.5 + (l_quantity / 10 - 2) / 1.5 / 240 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 81), lambda i: (CASE WHEN i IN (0, 80) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
          " * exp(-pow((l_quantity / 10 - 2) / 1.5 * i / 80, 2) / 2))), 8)"),
})


def _hmac_sql(digest: str) -> str:
    """The keyed hash of n_name, by its definition: the key's two pads are constants."""
    inner, outer = (bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"upper({digest}(unhex('{outer}') || unhex({digest}(unhex('{inner}') || encode(n_name)))))"


_family("hmac", "nation", "n_nationkey", {f"hmac_{n}": (lambda n=n: F.hex(p(f"hmac_{n}", _b(), F.encode(lit("key"), "UTF-8"))), _hmac_sql(n)) for n in ("md5", "sha1", "sha256")})
_family("lenient_digests", "part", "p_partkey", {"s256": (lambda: s("sha2", c("p_name"), 256), "sha256(p_name)"), "s1": (lambda: s("sha1", c("p_name")), "sha1(p_name)")})
QUERIES["fn_random"] = (lambda spark, sf_dir: tables(spark, sf_dir).orders.select("o_orderkey", p("random", lit(10)).between(0, 9).alias("ok"), (p("rand") < 1).alias("ok2"), (F.size(p("shuffle", F.array(lit(1), lit(2)))) == 2).alias("ok3")), "SELECT o_orderkey, true AS ok, true AS ok2, true AS ok3 FROM orders")
_family("lenient", "part", "p_partkey", {
    **{n: (lambda n=n: s(n, c("p_type")), f"{d}(p_type)") for n, d in (("lower", "lower"), ("upper", "upper"), ("length", "length"), ("ascii", "ascii"), ("md5", "md5"))}, "dow": (lambda: s("dow", lit("2024-03-05").cast("date")), "3"), "div0": (lambda: s("divide", c("p_size"), lit(0)), "CAST(NULL AS DOUBLE)"),
    "rem": (lambda: s("remainder", c("p_size"), lit(7)), "p_size % 7"), "pmod": (lambda: s("pmod", -c("p_size"), lit(7)), "((-p_size % 7) + 7) % 7"), "left2": (lambda: s("left", c("p_type"), lit(2)), "left(p_type, 2)"), "sub": (lambda: s("substring_index", c("p_brand"), lit("#"), lit(1)), "split_part(p_brand, '#', 1)"),
    "tr": (lambda: s("translate", c("p_type"), "AE", "xy"), "translate(p_type, 'AE', 'xy')"), "find": (lambda: s("find_in_set", lit("b"), lit("a,b")), "2"), "sh": (lambda: s("shiftleft", c("p_size"), lit(2)), "p_size * 4"), "bitget": (lambda: s("bit_get", c("p_size"), lit(0)), "p_size % 2"), "hyp": (_r(lambda: s("hypot", c("p_size"), lit(3))), "round(sqrt(p_size * p_size + 9), 8)"),
    "bin": (lambda: s("bin", c("p_size")), "bin(p_size)"), "eqn": (lambda: s("equalnullsafe", F.nullif("p_size", lit(3)), lit(None)), "p_size = 3"), "great": (lambda: s("greatest", F.nullif("p_size", lit(3)), lit(0)), "coalesce(nullif(p_size, 3), 0)"), "nd": (lambda: s("next_day", lit("2024-03-05").cast("date"), lit("MON")), "DATE '2024-03-11'"),
    "am": (lambda: s("add_months", lit("2024-01-31").cast("date"), lit(1)), "DATE '2024-02-29'"), "dd": (lambda: s("datediff", lit("2024-03-05").cast("date"), lit("2024-03-01").cast("date")), "4"), "un": (lambda: s("unscaled_value", F.lit("1.25").cast("decimal(5,2)"), 2), "125"), "tc": (lambda: s("try_cast", c("p_type"), "int"), "TRY_CAST(p_type AS INTEGER)"),
    "ov": (lambda: s("overlay", c("p_type"), lit("_"), lit(2)), "left(p_type, 1) || '_' || substr(p_type, 3)"), "json": (lambda: s("get_json_object", lit('{"a":1}'), lit("$.a")), "'1'"), "not_": (lambda: s("not", c("p_size") > 3), "p_size <= 3"), "conv": (lambda: s("conv", F.hex("p_size"), 16, 10), "p_size::VARCHAR"),
})
QUERIES["fn_lenient_hashes"] = (lambda spark, sf_dir: tables(spark, sf_dir).part.select("p_partkey", s("hash", c("p_name")).alias("h"), s("xxhash64", c("p_name")).alias("x"), s("hash_with_seed", 42, c("p_name")).alias("hs"), s("xxhash64_with_seed", 42, c("p_name")).alias("xs"), s("sha2", c("p_name"), 256).alias("s2"), s("rand", 1).alias("r")), None)
