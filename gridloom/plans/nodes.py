"""A small logical tree above DataFrames. ``lower`` turns a node into a DataFrame; from there Catalyst takes over."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.ml import models


@dataclass(frozen=True, eq=False)
class Call:
    """A kernel over a vector: one column, or several joined end to end. ``form`` says how it is carried out.

    Forms: 'udf' (numpy over Arrow batches); 'blocks' (rows joined with blocks of the weights, summed by row);
    'columns' (column blocks of the weights, results joined); 'trees' (rows with every tree, summed); 'sum' (adds its
    inputs, which are partial products).
    """

    name: str
    kernel: models.Kernel | None
    inputs: tuple[str, ...]
    form: str = "udf"

    def label(self) -> str:
        inner = "+".join(type(x).__name__ for x in self.kernel.layers) if isinstance(self.kernel, models.Stack) else type(self.kernel).__name__
        return f"{self.name}={inner}[{self.form}]({','.join(self.inputs)})"


class Node:
    def children(self) -> tuple[Node, ...]:
        return ()

    def with_children(self, *children: Node) -> Node:
        return self

    def columns(self) -> tuple[str, ...]:
        raise NotImplementedError

    def widths(self) -> dict[str, int]:
        """Lengths of the vector columns, as far as they are known."""
        raise NotImplementedError

    def lower(self) -> DataFrame:
        raise NotImplementedError

    def key(self) -> str:
        """The same for plans that are carried out the same way."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Source(Node):
    name: str
    df: DataFrame
    rows: float
    vectors: dict[str, int] = field(default_factory=dict)

    def columns(self):
        return tuple(self.df.columns)

    def widths(self):
        return dict(self.vectors)

    def lower(self):
        return self.df

    def key(self):
        return self.name


@dataclass(frozen=True, eq=False)
class Filter(Node):
    child: Node
    predicate: str
    uses: tuple[str, ...]
    selectivity: float = 0.5

    def children(self):
        return (self.child,)

    def with_children(self, *c):
        return replace(self, child=c[0])

    def columns(self):
        return self.child.columns()

    def widths(self):
        return self.child.widths()

    def lower(self):
        return self.child.lower().filter(self.predicate)

    def key(self):
        return f"filter({self.predicate})[{self.child.key()}]"


@dataclass(frozen=True, eq=False)
class Join(Node):
    left: Node
    right: Node
    left_key: str
    right_key: str
    matches: float = 1.0  # rows of the result for each row of the left side

    def children(self):
        return (self.left, self.right)

    def with_children(self, *c):
        return replace(self, left=c[0], right=c[1])

    def columns(self):
        return (*self.left.columns(), *self.right.columns())

    def widths(self):
        return self.left.widths() | self.right.widths()

    def lower(self):
        """A right side with vectors is shuffled, not broadcast: the planner counts a vector as one number, so what it takes for small would fill the driver."""
        right = self.right.lower()
        return self.left.lower().join(right.hint("merge") if self.right.widths() else right, F.col(self.left_key) == F.col(self.right_key))

    def key(self):
        return f"join({self.left_key}={self.right_key})[{self.left.key()},{self.right.key()}]"


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    child: Node
    keys: tuple[str, ...]
    aggregates: dict[str, str]
    groups: float = 100.0

    def children(self):
        return (self.child,)

    def with_children(self, *c):
        return replace(self, child=c[0])

    def columns(self):
        return (*self.keys, *self.aggregates)

    def widths(self):
        return {}

    def lower(self):
        return self.child.lower().groupBy(*self.keys).agg(*(F.expr(e).alias(n) for n, e in self.aggregates.items()))

    def key(self):
        return f"agg({self.keys},{sorted(self.aggregates.items())})[{self.child.key()}]"


@dataclass(frozen=True, eq=False)
class Project(Node):
    """Adds one column for each call, in order; a call may use those before it. ``keep`` names the columns that stay, all if empty."""

    child: Node
    calls: tuple[Call, ...]
    keep: tuple[str, ...] = ()

    def children(self):
        return (self.child,)

    def with_children(self, *c):
        return replace(self, child=c[0])

    def columns(self):
        return self.keep or (*self.child.columns(), *(c.name for c in self.calls))

    def widths(self):
        known = self.child.widths()
        for c in self.calls:
            n = sum(known.get(i, 1) for i in c.inputs) if c.form != "sum" else known.get(c.inputs[0], 1)
            known[c.name] = c.kernel.out_width(n) if c.kernel else n
        return known

    def lower(self):
        df = self.child.lower()
        for c in self.calls:
            df = lower_call(df, c)
        return df.select(*self.keep) if self.keep else df

    def key(self):
        return f"project({';'.join(c.label() for c in self.calls)}->{self.keep})[{self.child.key()}]"


def lower_call(df: DataFrame, call: Call) -> DataFrame:
    vector = F.col(call.inputs[0]) if len(call.inputs) == 1 else F.concat(*(F.col(c).cast("array<double>") for c in call.inputs))
    if call.form == "udf":
        return df.withColumn(call.name, models.apply(call.kernel, vector))
    if call.form == "sum":
        out = F.col(call.inputs[0])
        for c in call.inputs[1:]:
            out = F.zip_with(out, F.col(c), lambda a, b: a + b)
        return df.withColumn(call.name, out)
    return {"blocks": _blocks, "columns": _columns, "trees": _trees}[call.form](df, call, vector)


def _keyed(df: DataFrame, vector) -> tuple[DataFrame, DataFrame]:
    """Rows with a key made from their vector, and the distinct vectors by key.

    The key is a function of the row, so it is the same whenever a task is run again, and rows with equal vectors
    share one evaluation; equal keys of different vectors can't meet, as the vector is part of what is joined.
    """
    keyed = df.withColumn("_vector", vector.cast("array<double>"))
    keyed = keyed.withColumn("_key", F.sha2(F.array_join(F.transform("_vector", lambda x: x.cast("string")), ",").cast("binary"), 256))
    return keyed, keyed.filter("_vector IS NOT NULL").groupBy("_key").agg(F.first("_vector").alias("_vector"))


BLOCK = 16


def _blocks(df: DataFrame, call: Call, vector) -> DataFrame:
    """Matrix product as a join and an aggregation: vector blocks meet weight blocks of their row, partial vectors are summed by column block."""
    weights, spark = call.kernel.weights, df.sparkSession
    keyed, distinct = _keyed(df, vector)
    table = spark.createDataFrame([(i, j, part.tolist()) for i, j, part in models.blocks(weights, BLOCK)], "wi int, wj int, w array<array<double>>")
    n = -(-weights.shape[0] // BLOCK)
    parts = distinct.select("_key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("wi"), F.slice("_vector", i * BLOCK + 1, F.lit(BLOCK)).alias("x")))).alias("p")).select("_key", "p.wi", "p.x")
    met = parts.join(F.broadcast(table), "wi")  # the weights: a fixed size
    product = F.transform(F.sequence(F.lit(0), F.size(F.element_at("w", 1)) - 1), lambda j: F.aggregate(F.zip_with("x", "w", lambda a, r: a * F.get(r, j)), F.lit(0.0), lambda s, v: s + v))
    each = met.select("_key", "wj", F.posexplode(product).alias("at", "v")).groupBy("_key", "wj", "at").agg(F.sum("v").alias("v"))
    made = each.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("wj", "at", "v"))), lambda s: s["v"]).alias(call.name))
    return keyed.join(made, "_key", "left").drop("_key", "_vector")


def _columns(df: DataFrame, call: Call, vector) -> DataFrame:
    """Matrix product by column blocks of the weights, whose results are joined in order."""
    weights, spark = call.kernel.weights, df.sparkSession
    keyed, distinct = _keyed(df, vector)
    table = spark.createDataFrame([(j, weights[:, a : a + BLOCK].T.tolist()) for j, a in enumerate(range(0, weights.shape[1], BLOCK))], "wj int, w array<array<double>>")
    met = distinct.crossJoin(F.broadcast(table))  # the weights: a fixed size
    product = F.transform("w", lambda c: F.aggregate(F.zip_with("_vector", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    each = met.select("_key", "wj", product.alias("y"))
    made = each.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("wj", "y"))), lambda s: s["y"])).alias(call.name))
    return keyed.join(made, "_key", "left").drop("_key", "_vector")


def _trees(df: DataFrame, call: Call, vector) -> DataFrame:
    """A forest as a relation: every vector with every tree's number, predictions summed by vector."""
    forest = call.kernel
    keyed, distinct = _keyed(df, vector)
    spread = distinct.select("_key", "_vector", F.explode(F.sequence(F.lit(0), F.lit(len(forest.trees) - 1))).alias("tree"))

    def run(x: pa.Array, tree: pa.Array) -> pa.Array:
        rows, number, out = models.matrix(x), tree.to_numpy(), np.zeros(len(x))
        for t in np.unique(number):
            own = number == t
            out[own] = forest.trees[t](rows[own])[:, 0]
        return pa.array(out)

    run.__annotations__ = {"x": pa.Array, "tree": pa.Array, "return": pa.Array}
    mean = F.sum("leaf") / len(forest.trees)
    value = (mean > 0).cast("double") if forest.classification else mean
    made = spread.select("_key", F.arrow_udf(run, "double")("_vector", "tree").alias("leaf")).groupBy("_key").agg(F.array(value).alias(call.name))
    return keyed.join(made, "_key", "left").drop("_key", "_vector")
