"""Plans from outside: Substrait in its JSON form, to a DataFrame.

Read (a named table, files or rows), filter, project, aggregate, sort and fetch, with field references, literals, casts,
conditions, lists of values and the functions of FUNCTIONS and AGGREGATES. Fields have no names in a plan, only places:
within a plan columns are c0, c1, ..., and the root's names are given at the end.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of Substrait's functions.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b, "modulus": lambda a, b: a % b, "negate": F.negative, "abs": F.abs,
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "is_null": F.isnull, "is_not_null": F.isnotnull, "is_nan": F.isnan, "is_not_distinct_from": lambda a, b: a.eqNullSafe(b), "between": lambda x, a, b: x.between(a, b),
    "and": lambda *a: _fold(lambda x, y: x & y, a), "or": lambda *a: _fold(lambda x, y: x | y, a), "not": lambda a: ~a, "coalesce": F.coalesce, "if_then": lambda c, a, b: F.when(c, a).otherwise(b),
    "like": F.like, "substring": F.substring, "concat": F.concat, "lower": F.lower, "upper": F.upper, "char_length": F.length, "starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains,
    "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "power": F.pow, "round": F.round, "ceil": F.ceil, "floor": F.floor, "alias": lambda a: a,
}
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda x=None: F.count(F.lit(1) if x is None else x), "any_value": F.any_value, "stddev": F.stddev, "variance": F.variance,
    "bool_and": F.bool_and, "bool_or": F.bool_or, "approx_count_distinct": F.approx_count_distinct,
}
#: Substrait's simple types.
TYPES = {"bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "fp32": "float", "fp64": "double", "string": "string", "varchar": "string", "fixedChar": "string", "binary": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestampTz": "timestamp"}
DIRECTIONS = {
    "SORT_DIRECTION_ASC_NULLS_FIRST": "asc_nulls_first", "SORT_DIRECTION_ASC_NULLS_LAST": "asc_nulls_last", "SORT_DIRECTION_DESC_NULLS_FIRST": "desc_nulls_first", "SORT_DIRECTION_DESC_NULLS_LAST": "desc_nulls_last",
}
FILES = {"parquet": "parquet", "orc": "orc", "arrow": None, "dwrf": None}


def _fold(f: Callable[[Column, Column], Column], columns: tuple[Column, ...]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = f(out, c)
    return out


def type_name(kind: dict) -> str:
    """A Substrait type as a type of the session."""
    (name, detail), *_ = ((k, v) for k, v in kind.items() if k != "nullability")
    if name == "decimal":
        return f"decimal({detail.get('precision', 38)},{detail.get('scale', 0)})"
    if name == "list":
        return f"array<{type_name(detail['type'])}>"
    if name == "map":
        return f"map<{type_name(detail['key'])},{type_name(detail['value'])}>"
    if name == "struct":
        return f"struct<{','.join(f'c{i}:{type_name(t)}' for i, t in enumerate(detail['types']))}>"
    if name not in TYPES:
        raise ValueError(f"no such type: {name}")
    return TYPES[name]


class Importer:
    """Turns the relations of one plan into DataFrames; ``tables`` gives the frame of a named table."""

    def __init__(self, spark: SparkSession, plan: dict, tables: Callable[[str], DataFrame]):
        self.spark, self.tables = spark, tables
        called = [e["extensionFunction"] for e in plan.get("extensions", ()) if "extensionFunction" in e]
        self.names = {f.get("functionAnchor", 0): f["name"].split(":")[0] for f in called}
        self.outer = f"c{id(self)}"

    def relation(self, rel: dict) -> DataFrame:
        (name, body), *_ = ((k, v) for k, v in rel.items())
        build = {"read": self._read, "filter": self._filter, "project": self._project, "aggregate": self._aggregate, "sort": self._sort, "fetch": self._fetch}.get(name)
        if build is None:
            raise ValueError(f"no such relation: {name}")
        made = build(body)
        kept = body.get("common", {}).get("emit", {}).get("outputMapping")
        return self._numbered(made.select(*(F.col(f"c{i}") for i in kept)) if kept is not None else made)

    @staticmethod
    def _numbered(df: DataFrame) -> DataFrame:
        return df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def _read(self, body: dict) -> DataFrame:
        schema = body.get("baseSchema", {})
        names, kinds = schema.get("names", []), [type_name(t) for t in schema.get("struct", {}).get("types", ())]
        if "virtualTable" in body:
            rows = [tuple(self._value(v)[0] for v in row.get("fields", ())) for row in body["virtualTable"]["values"]]
            df = self.spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
        elif "localFiles" in body:
            frames = []
            for item in body["localFiles"]["items"]:
                kind = next((FILES[k] for k in FILES if k in item), "parquet")
                if kind is None:
                    raise ValueError("no reader for this kind of file")
                frames.append(self.spark.read.format(kind).load(item.get("uriFile") or item.get("uriPath") or item["uriFolder"]).select(*names))
            df = frames[0]
            for more in frames[1:]:
                df = df.union(more)
        else:
            df = self.tables(".".join(body["namedTable"]["names"]))
            df = df.select(*names) if names else df
        df = self._numbered(df)
        return df.filter(self.expression(body["filter"])) if body.get("filter") else df

    def _filter(self, body: dict) -> DataFrame:
        return self.relation(body["input"]).filter(self.expression(body["condition"]))

    def _project(self, body: dict) -> DataFrame:
        """The input's fields, then the expressions; an emit list picks among both."""
        df = self.relation(body["input"])
        width = len(df.columns)
        return df.select("*", *(self.expression(e).alias(f"c{width + i}") for i, e in enumerate(body.get("expressions", ()))))

    def _aggregate(self, body: dict) -> DataFrame:
        df = self.relation(body["input"])
        groupings = [[self.expression(e) for e in g.get("groupingExpressions", ())] for g in body.get("groupings", ())]
        if len(groupings) > 1:
            raise ValueError("one grouping only")
        keys = [e.alias(f"k{i}") for i, e in enumerate(groupings[0])] if groupings else []
        measures = [self._measure(m).alias(f"m{i}") for i, m in enumerate(body.get("measures", ()))]
        return df.groupBy(*keys).agg(*measures) if measures else df.select(*keys).distinct()

    def _measure(self, measure: dict) -> Column:
        call = measure["measure"]
        name = self._name(call)
        if name not in AGGREGATES:
            raise ValueError(f"no such aggregate: {name}")
        arguments = [self.expression(a["value"]) for a in call.get("arguments", ())]
        if measure.get("filter"):
            mask = self.expression(measure["filter"])
            arguments = [F.when(mask, a) for a in arguments or [F.lit(1)]]
        if call.get("invocation") == "AGGREGATION_INVOCATION_DISTINCT":
            if name not in ("count", "sum"):
                raise ValueError(f"{name} of distinct values isn't supported")
            return F.count_distinct(*arguments) if name == "count" else F.sum_distinct(*arguments)
        return AGGREGATES[name](*arguments)

    def _orders(self, sorts: list[dict]) -> list[Column]:
        return [getattr(self.expression(s["expr"]), DIRECTIONS[s.get("direction", "SORT_DIRECTION_ASC_NULLS_LAST")])() for s in sorts]

    def _sort(self, body: dict) -> DataFrame:
        return self.relation(body["input"]).orderBy(*self._orders(body["sorts"]))

    def _fetch(self, body: dict) -> DataFrame:
        df, offset, count = self.relation(body["input"]), int(body.get("offset", 0)), int(body.get("count", -1))
        df = df.offset(offset) if offset else df
        return df.limit(count) if count >= 0 else df

    def _name(self, call: dict) -> str:
        anchor = call.get("functionReference", 0)
        if anchor not in self.names:
            raise ValueError(f"no function is declared as {anchor}")
        return self.names[anchor]

    def expression(self, e: dict) -> Column:
        if "selection" in e:
            return F.col(f"c{e['selection']['directReference'].get('structField', {}).get('field', 0)}")
        if "literal" in e:
            value, kind = self._value(e["literal"])
            return F.lit(value).cast(kind)
        if "scalarFunction" in e:
            name = self._name(e["scalarFunction"])
            if name not in FUNCTIONS:
                raise ValueError(f"no such function: {name}")
            return FUNCTIONS[name](*(self.expression(a["value"]) for a in e["scalarFunction"].get("arguments", ())))
        if "cast" in e:
            return self.expression(e["cast"]["input"]).cast(type_name(e["cast"]["type"]))
        if "ifThen" in e:
            out = F
            for part in e["ifThen"]["ifs"]:
                out = out.when(self.expression(part["if"]), self.expression(part["then"]))
            return out.otherwise(self.expression(e["ifThen"]["else"])) if "else" in e["ifThen"] else out
        if "singularOrList" in e:
            value = self.expression(e["singularOrList"]["value"])
            return _fold(lambda x, y: x | y, tuple(value == self.expression(o) for o in e["singularOrList"]["options"]))
        raise ValueError(f"no such expression: {', '.join(e)}")

    def _value(self, literal: dict) -> tuple:
        """A literal's value and its type."""
        if "null" in literal:
            return None, type_name(literal["null"])
        (name, value), *_ = ((k, v) for k, v in literal.items() if k not in ("nullable", "typeVariationReference"))
        if name == "decimal":
            scale = value.get("scale", 0)
            unscaled = int.from_bytes(base64.b64decode(value["value"]), "little", signed=True)
            return decimal.Decimal(unscaled).scaleb(-scale), f"decimal({value.get('precision', 38)},{scale})"
        if name == "list":
            values = [self._value(v) for v in value["values"]]
            return [v for v, _ in values], f"array<{values[0][1]}>"
        if name in ("varChar", "fixedChar"):
            return (value["value"] if isinstance(value, dict) else value), "string"
        if name == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(days=int(value)), "date"
        if name in ("timestamp", "timestampTz"):
            return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=int(value)), TYPES[name]
        if name == "boolean":
            return bool(value), "boolean"
        if name not in TYPES:
            raise ValueError(f"no such literal: {name}")
        python = float if name.startswith("fp") else int if name.startswith("i") else base64.b64decode if name == "binary" else str
        return python(value), TYPES[name]


def from_substrait(spark: SparkSession, plan: dict | str, tables: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a plan with one relation; its root, if it has one, names the columns."""
    plan = json.loads(plan) if isinstance(plan, str) else plan
    (top,) = plan["relations"]
    importer = Importer(spark, plan, tables)
    if "root" not in top:
        return importer.relation(top["rel"])
    made = importer.relation(top["root"]["input"])
    names = top["root"].get("names", [])
    return made.toDF(*names) if names else made
