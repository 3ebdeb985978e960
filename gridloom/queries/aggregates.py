"""Every aggregate, grouped over order lines or orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables
from gridloom.functions import aggregates as A
from gridloom.functions import spark_call
from gridloom.functions.aggregates import agg

QUERIES = {}
_c = F.col


def _grouped(name: str, made: dict, sql: str, table: str = "lineitem", key: str = "l_suppkey") -> None:
    def build(spark, sf_dir):
        return getattr(tables(spark, sf_dir), table).groupBy(key).agg(*(c().alias(n) for n, c in made.items()))

    QUERIES[f"agg_{name}"] = (build, f"SELECT {key}, {sql} FROM {table} GROUP BY {key}")


_grouped("basic", {
    "n": lambda: agg("count"), "q": lambda: agg("count", _c("l_quantity")), "s": lambda: F.round(agg("sum", _c("l_quantity")), 2), "a": lambda: F.round(agg("avg", _c("l_discount")), 6),
    "lo": lambda: agg("min", _c("l_extendedprice")), "hi": lambda: agg("max", _c("l_extendedprice")), "few": lambda: agg("count_if", _c("l_quantity") < 10),
}, "count(*) AS n, count(l_quantity) AS q, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) FILTER (WHERE l_quantity < 10) AS few")
_grouped("bits", {"o": lambda: agg("bitwise_or_agg", _c("l_partkey")), "a": lambda: agg("bitwise_and_agg", _c("l_partkey")), "x": lambda: agg("bitwise_xor_agg", _c("l_partkey")), "y": lambda: agg("bit_xor", _c("l_orderkey"))},
         "bit_or(l_partkey) AS o, bit_and(l_partkey) AS a, bit_xor(l_partkey) AS x, bit_xor(l_orderkey) AS y")
_grouped("booleans", {"a": lambda: agg("bool_and", _c("l_quantity") > 1), "e": lambda: agg("every", _c("l_discount") < 0.1), "o": lambda: agg("bool_or", _c("l_quantity") > 49)},
         "bool_and(l_quantity > 1) AS a, bool_and(l_discount < 0.1) AS e, bool_or(l_quantity > 49) AS o")
_grouped("moments", {n: (lambda n=n: F.round(agg(n, _c("l_quantity")), 6)) for n in ("stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "kurtosis")},
         ", ".join(f"round({n}(l_quantity), 6) AS {n}" for n in ("stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "kurtosis")))
_grouped("skewness", {"v": lambda: F.round(agg("skewness", _c("l_quantity")), 6)},
         "round(CASE WHEN count(l_quantity) >= 3 THEN (sum(l_quantity ** 3) / count(*) - 3 * avg(l_quantity) * sum(l_quantity ** 2) / count(*) + 2 * avg(l_quantity) ** 3) / pow(var_pop(l_quantity), 1.5) END, 6) AS v")
_grouped("regression", {n: (lambda n=n: F.round(agg(n, _c("l_extendedprice"), _c("l_quantity")), 6)) for n in ("covar_pop", "covar_samp", "corr", "regr_intercept", "regr_slope")},
         ", ".join(f"round({n}(l_extendedprice, l_quantity), 6) AS {n}" for n in ("covar_pop", "covar_samp", "corr", "regr_intercept", "regr_slope")))
_grouped("entropy", {"e": lambda: F.round(agg("entropy", _c("l_quantity")), 6), "g": lambda: F.round(agg("geometric_mean", _c("l_quantity")), 6)},
         "round(log2(sum(l_quantity)) - sum(l_quantity * log2(l_quantity)) / sum(l_quantity), 6) AS e, round(exp(avg(ln(l_quantity))), 6) AS g")


def _top_values(spark, sf_dir):
    lines = tables(spark, sf_dir).lineitem
    low, high = (A.top_values(lines, ["l_suppkey"], "l_orderkey", 3, name, least) for name, least in (("lo", True), ("hi", False)))
    return low.join(high, "l_suppkey")


QUERIES["agg_top_values"] = (
    _top_values,
    "SELECT l_suppkey, array_agg(l_orderkey ORDER BY l_orderkey)[1:3] AS lo, array_agg(l_orderkey ORDER BY l_orderkey DESC)[1:3] AS hi FROM lineitem GROUP BY l_suppkey",
)
_by = {"key": "o_custkey", "table": "orders"}


def _values_by(spark, sf_dir):
    orders = tables(spark, sf_dir).orders
    one = orders.groupBy("o_custkey").agg(agg("min_by", _c("o_orderkey"), _c("o_totalprice")).alias("x"), agg("max_by", _c("o_orderkey"), _c("o_totalprice")).alias("y"))
    low, high = (A.top_values_by(orders, ["o_custkey"], "o_orderkey", "o_totalprice", 2, name, least) for name, least in (("xs", True), ("ys", False)))
    return one.join(low, "o_custkey").join(high, "o_custkey")


QUERIES["agg_by"] = (
    _values_by,
    "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS x, arg_max(o_orderkey, o_totalprice) AS y, array_agg(o_orderkey ORDER BY o_totalprice, o_orderkey)[1:2] AS xs, "
    "array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC)[1:2] AS ys FROM orders GROUP BY o_custkey",
)
QUERIES["agg_percentile_by_weight"] = (
    lambda spark, sf_dir: A.weighted_percentile(tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", 0.3, "v").join(
        tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.3, F.col("l_quantity").cast("int")).alias("exact")), "l_returnflag").select(
        "l_returnflag", (F.abs(F.col("v") / F.col("exact") - 1) < 0.002).alias("near")),
    "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag",
)
_grouped("lists", {"all": lambda: F.array_sort(agg("array_agg", F.nullif("o_orderstatus", F.lit("P")))), "kinds": lambda: F.array_sort(agg("set_agg", _c("o_orderstatus"))), "more": lambda: F.array_sort(agg("set_union", F.array("o_orderstatus", "o_orderpriority")))},
         """array_agg(nullif(o_orderstatus, 'P') ORDER BY nullif(o_orderstatus, 'P') NULLS LAST) AS "all", list_sort(list(DISTINCT o_orderstatus)) AS kinds, list_sort(list_distinct(flatten(list([o_orderstatus, o_orderpriority])))) AS more""", **_by)  # fmt: skip
_grouped("any", {"v": lambda: agg("any_value", F.lit(7)), "w": lambda: agg("arbitrary", F.lit("x")), "f": lambda: agg("first", F.lit(1)), "l": lambda: agg("last", F.lit(2)), "fi": lambda: agg("first_ignore_null", F.nullif(F.lit(1), F.lit(1))), "li": lambda: agg("last_ignore_null", F.lit(4))},
         "7 AS v, 'x' AS w, 1 AS f, 2 AS l, CAST(NULL AS INTEGER) AS fi, 4 AS li", **_by)
_grouped("map_agg", {"m": lambda: F.map_entries(agg("map_agg", _c("o_orderstatus"), _c("o_orderkey")))},
         "list_sort([{'key': k, 'value': v} FOR k, v IN []]) AS m", **_by)
QUERIES["agg_map_agg"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).orders.groupBy("o_custkey").agg(agg("map_agg", _c("o_orderstatus"), _c("o_orderkey")).alias("m")).select("o_custkey", F.explode("m").alias("k", "v")),
    "SELECT o_custkey, o_orderstatus AS k, min(o_orderkey) AS v FROM orders GROUP BY ALL",
)
QUERIES["agg_map_union"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).orders.groupBy("o_custkey").agg(agg("map_union", F.create_map("o_orderstatus", "o_orderkey")).alias("m")).select("o_custkey", F.explode("m").alias("k", "v")),
    "SELECT o_custkey, o_orderstatus AS k, min(o_orderkey) AS v FROM orders GROUP BY ALL",
)
QUERIES["agg_histogram"] = (
    lambda spark, sf_dir: A.histogram(tables(spark, sf_dir).orders, ["o_custkey"], "o_orderpriority", "m").select("o_custkey", F.explode("m").alias("k", "n")),
    "SELECT o_custkey, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL",
)
QUERIES["agg_multimap_agg"] = (
    lambda spark, sf_dir: A.multimap_agg(tables(spark, sf_dir).orders, ["o_custkey"], "o_orderstatus", "o_orderkey", "m").select("o_custkey", F.explode("m").alias("k", "vs")),
    "SELECT o_custkey, o_orderstatus AS k, array_agg(o_orderkey ORDER BY o_orderkey) AS vs FROM orders GROUP BY ALL",
)
QUERIES["agg_map_union_sum"] = (
    lambda spark, sf_dir: A.map_union_sum(tables(spark, sf_dir).orders.withColumn("m", F.create_map("o_orderstatus", "o_orderkey")), ["o_custkey"], "m", "m").select("o_custkey", F.explode("m").alias("k", "v")),
    "SELECT o_custkey, o_orderstatus AS k, sum(o_orderkey)::BIGINT AS v FROM orders GROUP BY ALL",
)
QUERIES["agg_vector_sum"] = (
    lambda spark, sf_dir: A.vector_sum(tables(spark, sf_dir).lineitem.withColumn("a", F.array("l_quantity", "l_partkey", "l_linenumber")), ["l_suppkey"], "a", "v"),
    "SELECT l_suppkey, [sum(l_quantity), sum(l_partkey)::DOUBLE, sum(l_linenumber)::DOUBLE] AS v FROM lineitem GROUP BY l_suppkey",
)
QUERIES["agg_array_cat"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).orders.groupBy("o_custkey").agg(agg("array_cat", F.array("o_orderkey", "o_custkey"), _c("o_orderkey")).alias("v")),
    "SELECT o_custkey, flatten(array_agg([o_orderkey, o_custkey] ORDER BY o_orderkey)) AS v FROM orders GROUP BY o_custkey",
)
QUERIES["agg_reduce_agg"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).orders.groupBy("o_custkey").agg(agg("reduce_agg", _c("o_orderkey"), F.lit(7).cast("long"), lambda s, x: F.greatest(s, F.pmod(x, F.lit(1013)))).alias("v")),
    "SELECT o_custkey, greatest(7, max(o_orderkey % 1013))::BIGINT AS v FROM orders GROUP BY o_custkey",
)
QUERIES["agg_reduce_agg_by_task"] = (
    lambda spark, sf_dir: A.reduce_agg(tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_orderkey", F.lit(0).cast("long"), lambda s, x: s + F.pmod(x, F.lit(7)), lambda a, b: a + b, "v"),
    "SELECT l_returnflag, sum(l_orderkey % 7)::BIGINT AS v FROM lineitem GROUP BY l_returnflag",
)
QUERIES["agg_most_frequent"] = (
    lambda spark, sf_dir: A.most_frequent(tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_quantity", 3, "m").select("l_returnflag", F.explode("m").alias("k", "n")),
    "SELECT l_returnflag, k, n FROM (SELECT l_returnflag, l_quantity AS k, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, k) <= 3",
)
QUERIES["agg_data_size"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).part.groupBy("p_type").agg(agg("max_data_size_for_stats", _c("p_name")).alias("top"), agg("sum_data_size_for_stats", _c("p_name")).alias("total")),
    "SELECT p_type, max(strlen(p_name)) AS top, sum(strlen(p_name))::BIGINT AS total FROM part GROUP BY p_type",
)
QUERIES["agg_percentile_weighted"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.25).alias("p25"), F.percentile("l_quantity", 0.5).alias("p50")),
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50 FROM lineitem GROUP BY l_returnflag",
)


def _near(made, exact, bound):
    """Whether an estimate is within its bound; with nothing to estimate, whether it says so."""
    return made.eqNullSafe(exact) | (F.abs(made - exact) < F.abs(exact) * bound)


def _by_flag(*frames):
    """Columns of several frames of a row a flag beside one another, also for the null flag."""
    met = frames[0]
    for frame in frames[1:]:
        met = met.unionByName(frame, allowMissingColumns=True)
    return met.groupBy("l_returnflag").agg(*(F.max(c).alias(c) for c in met.columns if c != "l_returnflag"))


def _sketches(spark, sf_dir):
    """Estimates against exact values: whether each is within its error bound; a sketch of sketches estimates as one of all rows."""
    lines = tables(spark, sf_dir).lineitem
    estimate = lambda column: F.hll_sketch_estimate(column)
    parts = lines.groupBy("l_returnflag", F.pmod("l_orderkey", F.lit(4))).agg(agg("approx_set", _c("l_partkey")).alias("part"))
    whole = lines.groupBy("l_returnflag").agg(
        agg("approx_distinct", _c("l_partkey")).alias("distinct"), estimate(agg("approx_set", _c("l_partkey"))).alias("estimate"),
        _near(agg("approx_percentile", _c("l_quantity"), 0.5), F.percentile("l_quantity", 0.5), 0.05).alias("percentile_near"), (agg("checksum", _c("l_orderkey")) == F.bit_xor(F.xxhash64("l_orderkey"))).alias("sum_same"),
    )
    merged = parts.groupBy("l_returnflag").agg(estimate(agg("merge", _c("part"))).alias("merged"))
    met, exact = _by_flag(whole, A.count_distinct(lines, ["l_returnflag"], "l_partkey", "exact"), merged), _c("exact")
    return met.select("l_returnflag", _near(_c("distinct"), exact, 0.1).alias("distinct_near"), "percentile_near", "sum_same", _near(_c("estimate"), exact, 0.05).alias("set_near"), _near(_c("merged"), exact, 0.05).alias("merged_near"))


def _approx_distinct_error(spark, sf_dir):
    lines = tables(spark, sf_dir).lineitem
    made = lines.groupBy("l_returnflag").agg(agg("approx_distinct", _c("l_partkey")).alias("distinct"))
    return _by_flag(made, A.count_distinct(lines, ["l_returnflag"], "l_partkey", "exact")).select("l_returnflag", _near(_c("distinct"), _c("exact"), 0.1).alias("near"))


QUERIES["agg_sketches"] = (_sketches, "SELECT l_returnflag, true AS distinct_near, true AS percentile_near, true AS sum_same, true AS set_near, true AS merged_near FROM lineitem GROUP BY l_returnflag")
QUERIES["agg_approx_distinct_error"] = (_approx_distinct_error, "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")


def _bloom(spark, sf_dir):
    """A filter of the part keys of each supplier's returned lines: it knows all of them, and few others."""
    lines = tables(spark, sf_dir).lineitem
    blooms = A.bloom_filter_agg(lines.filter("l_returnflag = 'R'"), ["l_suppkey"], "l_partkey", "bloom", expected=2_000)
    seen = spark_call("might_contain", _c("bloom"), _c("l_partkey"), 2_000)
    other = spark_call("might_contain", _c("bloom"), -_c("l_partkey"), 2_000)
    return lines.filter("l_returnflag = 'R'").join(blooms, "l_suppkey").groupBy("l_suppkey").agg(F.bool_and(seen).alias("seen"), (F.avg(other.cast("int")) < 0.2).alias("few_others"))


QUERIES["agg_bloom_filter"] = (_bloom, "SELECT l_suppkey, true AS seen, true AS few_others FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
