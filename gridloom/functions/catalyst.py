"""Columns made of one Catalyst expression, for those that have no function or whose evaluation mode must be fixed."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def expression(name: str, *arguments) -> Column:
    """A Column of the expression class ``name``; Columns among its arguments become expressions."""
    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    given = (utils.expression(a._jc) if isinstance(a, Column) else a for a in arguments)
    made = utils.column(getattr(jvm.org.apache.spark.sql.catalyst.expressions, name)(*given))
    return type(F.lit(0))(made)


def option(value):
    """A Scala option; None is an empty one."""
    return SparkContext._active_spark_context._jvm.scala.Option.apply(value)


def unchecked():
    """Arithmetic that wraps around, whatever the session says."""
    expressions = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.expressions
    return expressions.NumericEvalContext(expressions.EvalMode.LEGACY(), True)


def attempt(x: Column) -> Column:
    """Null where working out ``x`` is an error."""
    return expression("TryEval", x)
