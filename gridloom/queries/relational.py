"""One query for each relational operator, over the driver's tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom import sources
from gridloom.catalog import tables

QUERIES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f"rel_{f.__name__}"] = (lambda spark, sf_dir: f(tables(spark, sf_dir)), sql)
        return f

    return register


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount = 0.1 AND l_orderkey % 2 = 0")
def table_scan(t):
    return sources.scan(t._spark, f"{t._folder}/lineitem.parquet", ["l_orderkey", "l_quantity"], ["l_quantity > 45", "l_discount = 0.1D"], "l_orderkey % 2 = 0")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (1, 'a'), (2, NULL)) v(k, s)")
def values(t):
    return sources.values(t._spark, [(1, "a"), (2, None)], "k int, s string", times=2)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0.5::DOUBLE), (2, NULL)) v(k, x)")
def arrow_stream(t):
    return sources.arrow(t._spark, pa.table({"k": pa.array([1, 2], pa.int64()), "x": pa.array([0.5, None])}))


@query("SELECT l_linenumber, count(*) AS n FROM (SELECT i % 4 + 1 AS l_linenumber FROM range(4000) r(i)) GROUP BY l_linenumber")
def generated_scan(t):
    return sources.generate(t._spark, 4000, 4).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
def filter(t):  # noqa: A001
    return op.filter_rows(t.orders, "o_orderpriority = '1-URGENT'", F.col("o_totalprice") > 200000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size * 2 AS twice, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part")
def project(t):
    return op.project(t.part, "p_partkey", "p_size * 2 AS twice", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind")


@query("""SELECT o_custkey, unnest(a) AS a_e, unnest(b) AS b_e, unnest(range(1, greatest(len(a), len(b)) + 1)) AS at FROM (
  SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS a, array_agg(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS b FROM orders GROUP BY o_custkey)""")
def unnest(t):
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"), F.sort_array(F.collect_set("o_orderstatus")).alias("b"))
    return op.unnest(lists, ["o_custkey"], ["a", "b"], "at")


@query("SELECT o_custkey, o_orderstatus AS m_k, count(*) AS m_v FROM orders GROUP BY ALL")
def unnest_map(t):
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return op.unnest(maps, ["o_custkey"], ["m"])


@query("SELECT n_nationkey AS k, n_name AS s, 0 AS kind FROM nation UNION ALL SELECT n_regionkey, NULL, 1 FROM nation")
def expand(t):
    return op.expand(t.nation, [["n_nationkey", "n_name", "0"], ["n_regionkey", "CAST(NULL AS STRING)", "1"]], ["k", "s", "kind"])


@query("SELECT count(*) AS n, count(*) AS ids FROM orders")
def assign_unique_id(t):
    return op.assign_unique_id(t.orders, "uid").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("ids"))


@query("SELECT r_name FROM region WHERE r_regionkey = 2")
def enforce_single_row(t):
    return op.enforce_single_row(t.region.filter("r_regionkey = 2").select("r_name"))


@query("SELECT CAST(NULL AS VARCHAR) AS r_name")
def enforce_single_row_empty(t):
    return op.enforce_single_row(t.region.filter("r_regionkey = 99").select("r_name"))


@query("""SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) AS parts
  FROM lineitem GROUP BY l_suppkey""")
def hash_aggregation(t):
    return op.aggregate(t.lineitem, ["l_suppkey"], {"n": "count(*)", "q": "round(sum(l_quantity), 2)", "returned": "count(*)", "parts": "count(DISTINCT l_partkey)"}, {"returned": "l_returnflag = 'R'"})


@query("SELECT nullif(o_orderstatus, 'P') AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def aggregation_ignores_null_keys(t):
    return op.aggregate(t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("k")), ["k"], {"n": "count(*)"}, ignore_null_keys=True)


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0")
def global_aggregation(t):
    return op.aggregate(t.orders.filter("o_orderkey < 0"), [], {"n": "count(*)", "total": "sum(o_totalprice)"})


@query("SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def streaming_aggregation(t):
    return op.aggregate(op.sort_partitions(t.orders.repartition("o_custkey"), "o_custkey"), ["o_custkey"], {"top": F.max("o_totalprice")})


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, round(sum(DISTINCT c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def distinct_aggregates(t):
    return op.aggregate(t.customer, ["c_nationkey"], {"segments": "count(DISTINCT c_mktsegment)", "total": "round(sum(DISTINCT c_acctbal), 2)"})


@query("SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS keys FROM orders GROUP BY o_custkey")
def sorted_aggregates(t):
    return op.sorted_aggregate(t.orders, ["o_custkey"], "keys", "o_orderkey", ["o_totalprice", "o_orderkey"], descending=True)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 AS first_one FROM orders")
def mark_distinct(t):
    return op.mark_distinct(t.orders, "first_one", ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "first_one")


@query("""SELECT l_returnflag, l_linestatus, gid, round(sum(l_quantity), 2) AS q FROM (
  SELECT l_returnflag, l_linestatus, 0 AS gid, l_quantity FROM lineitem UNION ALL SELECT l_returnflag, NULL, 1, l_quantity FROM lineitem UNION ALL SELECT NULL, NULL, 2, l_quantity FROM lineitem)
GROUP BY ALL""")
def group_id(t):
    replicated = op.group_id(t.lineitem, [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], ["l_quantity"], "gid")
    return replicated.groupBy("l_returnflag", "l_linestatus", "gid").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS gid, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def grouping_sets(t):
    return op.grouping_sets(t.customer, [["c_mktsegment", "c_nationkey"], ["c_mktsegment"], []], F.count("*").alias("n"), id_name="gid")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(t):
    joined = op.join(op.join(t.customer, t.nation, ["c_nationkey"], ["n_nationkey"]), t.region, ["n_regionkey"], ["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


def _sides(t):
    """Two small sides with keys on both, on one and null."""
    left = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 40).alias("a"))
    right = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") + 10).alias("b"))
    return left, right


_SIDES = "WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 END AS a FROM customer), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey + 10 END AS b FROM supplier) "


def _join(name, how, strategy=None, residual=False):
    @query(f"{_SIDES} SELECT c_custkey, a, s_suppkey, b FROM l {how.upper()} JOIN r ON a = b" + (" AND c_custkey > s_suppkey * 3" if residual else ""))
    def build(t):
        left, right = _sides(t)
        return op.join(left, right, ["a"], ["b"], how, F.col("c_custkey") > F.col("s_suppkey") * 3 if residual else None, strategy)

    QUERIES[f"rel_{name}"] = QUERIES.pop("rel_build")


for _how in ("inner", "left", "right", "full"):
    _join(f"hash_join_{_how}", _how, "hash")
    _join(f"hash_join_{_how}_residual", _how, "hash", residual=True)
for _how in ("inner", "left"):
    _join(f"merge_join_{_how}", _how, "merge")


@query(f"{_SIDES} SELECT c_custkey, a FROM l WHERE EXISTS (SELECT 1 FROM r WHERE a = b)")
def left_semi_filter(t):
    left, right = _sides(t)
    return op.semi_filter(left, right, ["a"], ["b"])


@query(f"{_SIDES} SELECT s_suppkey, b FROM r WHERE EXISTS (SELECT 1 FROM l WHERE a = b)")
def right_semi_filter(t):
    left, right = _sides(t)
    return op.semi_filter(right, left, ["b"], ["a"])


@query(f"{_SIDES} SELECT c_custkey, a, EXISTS (SELECT 1 FROM r WHERE a = b) AS found FROM l")
def left_semi_project(t):
    left, right = _sides(t)
    return op.semi_project(left, right, "a", "b", "found")


@query(f"{_SIDES} SELECT c_custkey, a, a IN (SELECT b FROM r) AS found FROM l")
def left_semi_project_null_aware(t):
    left, right = _sides(t)
    return op.semi_project(left, right, "a", "b", "found", null_aware=True)


@query(f"{_SIDES} SELECT s_suppkey, b, EXISTS (SELECT 1 FROM l WHERE a = b) AS found FROM r")
def right_semi_project(t):
    left, right = _sides(t)
    return op.semi_project(right, left, "b", "a", "found")


@query(f"{_SIDES} SELECT s_suppkey, b, b IN (SELECT a FROM l) AS found FROM r")
def right_semi_project_null_aware(t):
    left, right = _sides(t)
    return op.semi_project(right, left, "b", "a", "found", null_aware=True)


@query(f"{_SIDES} SELECT c_custkey, a FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE a = b)")
def anti_join(t):
    left, right = _sides(t)
    return op.anti_join(left, right, "a", "b")


@query(f"{_SIDES} SELECT c_custkey, a FROM l WHERE a NOT IN (SELECT b FROM r WHERE b IS NOT NULL)")
def anti_join_null_aware(t):
    left, right = _sides(t)
    return op.anti_join(left, right.filter("b IS NOT NULL"), "a", "b", null_aware=True)


@query(f"{_SIDES} SELECT c_custkey, a FROM l WHERE a NOT IN (SELECT b FROM r)")
def anti_join_null_aware_with_nulls(t):
    left, right = _sides(t)
    return op.anti_join(left, right, "a", "b", null_aware=True)


@query("SELECT r_name, n_name FROM region, nation")
def nested_loop_cross(t):
    return op.nested_loop_join(t.region.select("r_name"), t.nation.select("n_name"))


for _how in ("inner", "left", "right", "full"):

    @query(f"SELECT s_suppkey, n_nationkey FROM supplier {_how.upper()} JOIN nation ON s_nationkey > n_nationkey + 15")
    def build(t, how=_how):
        return op.nested_loop_join(t.supplier.select("s_suppkey", "s_nationkey"), t.nation.select("n_nationkey"), F.col("s_nationkey") > F.col("n_nationkey") + 15, how).select("s_suppkey", "n_nationkey")

    QUERIES[f"rel_nested_loop_{_how}"] = QUERIES.pop("rel_build")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders QUALIFY n <= 3")
def row_number(t):
    return op.row_number(t.orders, ["o_custkey"], ["o_orderkey"], "n", 3).select("o_orderkey", "n")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders QUALIFY n <= 2")
def top_n_row_number(t):
    return op.top_n_row_number(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2, "n").select("o_orderkey", "o_custkey", "n")


@query("SELECT nullif(c_nationkey, 3) AS a, c_custkey FROM customer ORDER BY a DESC NULLS FIRST, c_custkey")
def order_by(t):
    """The comparison is of rows; a test looks at their order."""
    return op.order_by(t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("a"), "c_custkey"), "a DESC NULLS FIRST", "c_custkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_n(t):
    return op.top_n(t.part.select("p_partkey", "p_retailprice"), 25, "p_retailprice DESC", "p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def limit(t):
    return op.limit(op.order_by(t.orders.select("o_orderkey"), "o_orderkey"), 10, 20)


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def partitioned_output(t):
    return op.repartition(t.supplier, "hash", 4, "s_nationkey").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def local_partition(t):
    dealt = op.repartition(op.repartition(t.orders, "round_robin", 6), "gather", 3)
    return dealt.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) ORDER BY k LIMIT 50")
def merge_exchange(t):
    return op.merge_sorted(t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), keys=["k"]).limit(50)


@query("SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) ORDER BY k")
def merge_exchange_all(t):
    return op.merge_sorted(t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), keys=["k"])


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return op.union_all(t.nation.select(F.col("n_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT n_regionkey FROM nation")
def union(t):
    return op.union(t.customer.select(F.col("c_nationkey").alias("k")), t.nation.select(F.col("n_regionkey").alias("k")))


_NULLED = "SELECT nullif(c_nationkey, 4) AS k FROM customer {} SELECT nullif(s_nationkey, 4) FROM supplier"


def _set(name, word, build):
    @query(_NULLED.format(word))
    def made(t):
        return build(t.customer.select(F.nullif("c_nationkey", F.lit(4)).alias("k")), t.supplier.select(F.nullif("s_nationkey", F.lit(4)).alias("k")))

    QUERIES[f"rel_{name}"] = QUERIES.pop("rel_made")


_set("intersect", "INTERSECT", op.intersect)
_set("intersect_all", "INTERSECT ALL", lambda a, b: op.intersect(a, b, all_rows=True))
_set("except", "EXCEPT", op.except_)
_set("except_all", "EXCEPT ALL", lambda a, b: op.except_(a, b, all_rows=True))
