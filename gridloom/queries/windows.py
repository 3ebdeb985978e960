"""Window functions, frames, and window functions whose arguments are columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom.catalog import tables

QUERIES = {}
_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _over(name: str, ours: str, theirs: str | None = None, frame: str = "", order: str = _BY) -> None:
    spec = f"({order} {frame})".replace(" )", ")")
    text = f"SELECT o_orderkey, {ours} OVER {spec} AS v FROM orders"
    QUERIES[f"win_{name}"] = (lambda spark, sf_dir: tables(spark, sf_dir).views("orders").sql(text), f"SELECT o_orderkey, {theirs or ours} OVER {spec} AS v FROM orders")


_over("row_number", "row_number()")
for _f in ("rank", "dense_rank"):
    _over(_f, f"{_f}()", order="PARTITION BY o_custkey ORDER BY o_orderstatus")
for _f in ("percent_rank", "cume_dist"):
    _over(_f, f"{_f}()", order="PARTITION BY o_orderstatus ORDER BY o_orderpriority")
_over("ntile", "ntile(4)")
_over("first_value", "first_value(o_totalprice)")
_over("last_value", "last_value(o_totalprice)", frame="ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
_over("nth_value", "nth_value(o_totalprice, 2)", frame="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
_over("lag", "lag(o_orderkey, 1)")
_over("lead_default", "lead(o_orderkey, 2, -1)")
_over("default_frame", "count(*)", order="PARTITION BY o_custkey ORDER BY o_orderstatus")
_over("rows_frame", "max(o_totalprice)", frame="ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING")
_over("rows_following", "min(o_totalprice)", frame="ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
_over("range_frame", "count(*)", order="PARTITION BY o_orderstatus ORDER BY o_custkey", frame="RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING")
_over("aggregate", "sum(o_orderkey)", theirs="CAST(sum(o_orderkey) ", frame="")
QUERIES["win_aggregate"] = (QUERIES["win_aggregate"][0], f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER ({_BY}) AS BIGINT) AS v FROM orders")
QUERIES["win_last_value_ignore_nulls"] = (
    lambda spark, sf_dir: tables(spark, sf_dir).views("orders").sql(f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'F')) IGNORE NULLS OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM orders"),
    f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'F') IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM orders",
)


def ntile_column(spark, sf_dir):
    rows = tables(spark, sf_dir).orders.withColumn("tiles", F.when(F.col("o_orderstatus") == "F", 3).otherwise(5).cast("long"))
    return op.ntile_by(rows, "tiles", ["o_orderstatus"], ["o_orderkey"], "v").select("o_orderkey", "v")


QUERIES["win_ntile_column"] = (ntile_column, "SELECT o_orderkey, ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F'")


def lag_column(spark, sf_dir):
    rows = tables(spark, sf_dir).orders.withColumn("back", F.pmod("o_orderkey", F.lit(3)))
    return op.shift_by(rows, "o_totalprice", "back", ["o_custkey"], ["o_orderkey"], "v").select("o_orderkey", "v")


QUERIES["win_lag_column"] = (lag_column, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN lag(o_totalprice, 1) OVER w ELSE lag(o_totalprice, 2) OVER w END AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")


def several(spark, sf_dir):
    rows = tables(spark, sf_dir).events
    out = op.window(rows, {"n": "count(*)", "top": F.max("value"), "at": F.row_number()}, ["user_id"], ["ts", "event_id"])
    return out.withColumn("of", F.count("*").over(Window.partitionBy("user_id"))).select("event_id", F.col("n"), "top", "at", "of")


QUERIES["win_several"] = (several, "SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top, row_number() OVER w AS at, count(*) OVER (PARTITION BY user_id) AS of FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
