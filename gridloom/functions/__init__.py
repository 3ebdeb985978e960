"""Two function dialects, aggregates and window functions: names mapped to builders of Columns."""

from gridloom.functions.aggregates import AGGREGATES, agg
from gridloom.functions.strict import STRICT, strict
from gridloom.functions.spark_dialect import SPARK, spark_call

__all__ = ["AGGREGATES", "STRICT", "SPARK", "agg", "strict", "spark_call"]
