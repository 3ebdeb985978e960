"""Plans from outside: Substrait in JSON, and join orders in JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables
from gridloom.plans import from_substrait, join_in_order

QUERIES = {}
_FUNCTIONS = ("multiply:opt_fp64_fp64", "subtract:opt_fp64_fp64", "and:bool", "lt:fp64_fp64", "gte:fp64_fp64", "sum:opt_fp64", "count:opt", "equal:str_str", "avg:opt_fp64", "add:opt_i64_i64")
_AT = {name.split(":")[0]: i for i, name in enumerate(_FUNCTIONS)}
_DOUBLE, _LONG, _TEXT = {"fp64": {}}, {"i64": {}}, {"string": {}}


def _field(i: int) -> dict:
    return {"selection": {"directReference": {"structField": {"field": i}}, "rootReference": {}}}


def _call(name: str, *arguments: dict) -> dict:
    return {"scalarFunction": {"functionReference": _AT[name], "arguments": [{"value": a} for a in arguments]}}


def _measure(name: str, *arguments: dict) -> dict:
    return {"measure": {"functionReference": _AT[name], "arguments": [{"value": a} for a in arguments]}}


def _read(table: str, **columns: dict) -> dict:
    return {"read": {"baseSchema": {"names": list(columns), "struct": {"types": list(columns.values())}}, "namedTable": {"names": [table]}}}


def _plan(rel: dict, *names: str) -> dict:
    called = [{"extensionFunction": {"functionAnchor": i, "name": name}} for i, name in enumerate(_FUNCTIONS)]
    return {"extensions": called, "relations": [{"root": {"input": rel, "names": list(names)}}]}


_real = lambda x: {"literal": {"fp64": x}}
_lines = _read("lineitem", l_quantity=_DOUBLE, l_extendedprice=_DOUBLE, l_discount=_DOUBLE, l_returnflag=_TEXT, l_orderkey=_LONG)
_few = _call("and", _call("lt", _field(0), _real(24)), _call("gte", _field(2), _real(0.05)))
_revenue = {"project": {"common": {"emit": {"outputMapping": [3, 5]}}, "input": {"filter": {"input": _lines, "condition": _few}}, "expressions": [_call("multiply", _field(1), _call("subtract", _real(1), _field(2)))]}}
REVENUE = _plan(
    {"sort": {
        "input": {"aggregate": {"input": _revenue, "groupings": [{"groupingExpressions": [_field(0)]}], "measures": [_measure("sum", _field(1)), _measure("count"), _measure("avg", _field(1))]}},
        "sorts": [{"expr": _field(0), "direction": "SORT_DIRECTION_ASC_NULLS_FIRST"}],
    }}, "l_returnflag", "revenue", "n", "mean",
)
FIRST = _plan({"fetch": {"offset": "5", "count": "20", "input": {"sort": {"input": _read("orders", o_orderkey=_LONG, o_orderstatus=_TEXT), "sorts": [{"expr": _field(0), "direction": "SORT_DIRECTION_DESC_NULLS_LAST"}]}}}}, "k", "status")
ROWS = _plan({"project": {
    "common": {"emit": {"outputMapping": [1, 2, 3]}},
    "input": {"read": {"baseSchema": {"names": ["a", "b"], "struct": {"types": [_LONG, _TEXT]}}, "virtualTable": {"values": [
        {"fields": [{"i64": "1"}, {"string": "x"}]}, {"fields": [{"i64": "2"}, {"null": _TEXT}]}, {"fields": [{"null": _LONG}, {"string": "z"}]}]}}},
    "expressions": [
        _call("add", _field(0), {"cast": {"type": _LONG, "input": {"literal": {"i32": 10}}}}),
        {"ifThen": {"ifs": [{"if": _call("equal", _field(1), {"literal": {"string": "x"}}), "then": {"literal": {"string": "first"}}}], "else": {"literal": {"string": "other"}}}},
    ],
}}, "b", "more", "which")


def _imported(plan: dict):
    return lambda spark, sf_dir: from_substrait(spark, plan, lambda name: getattr(tables(spark, sf_dir), name))


QUERIES["plan_substrait_aggregate"] = (
    lambda spark, sf_dir: _imported(REVENUE)(spark, sf_dir).select("l_returnflag", F.round("revenue", 2).alias("revenue"), "n", F.round("mean", 4).alias("mean")),
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 GROUP BY l_returnflag",
)
QUERIES["plan_substrait_fetch"] = (_imported(FIRST), "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5")
QUERIES["plan_substrait_values"] = (_imported(ROWS), "SELECT b, a + 10 AS more, CASE WHEN b = 'x' THEN 'first' ELSE 'other' END AS which FROM (VALUES (1::BIGINT, 'x'), (2, NULL), (NULL, 'z')) t(a, b)")

ORDER = """[
  {"ID": "0", "Left": "o", "Right": "c", "Pred": "o.o_custkey = c.c_custkey", "ProbeKeys": "o_custkey", "BuildKeys": "c_custkey", "Projection": ["o_orderkey", "c_nationkey", "o_totalprice"]},
  {"ID": "1", "Left": "0", "Right": "n", "Pred": "c.c_nationkey = n.n_nationkey", "ProbeKeys": "c_nationkey", "BuildKeys": "n_nationkey", "Projection": ["o_orderkey", "o_totalprice", "n_name", "n_regionkey"]},
  {"ID": "2", "Left": "1", "Right": "r", "Pred": "n.n_regionkey = r.r_regionkey", "ProbeKeys": "n_regionkey", "BuildKeys": "r_regionkey", "Projection": ["o_totalprice", "n_name", "r_name"]}
]"""


def _ordered(spark, sf_dir):
    t = tables(spark, sf_dir)
    joined = join_in_order(ORDER, {"o": t.orders, "c": t.customer, "n": t.nation, "r": t.region})
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES["plan_join_order"] = (
    _ordered,
    "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
)
