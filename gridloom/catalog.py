"""Tables of a data folder, read when they are first asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class tables:  # noqa: N801  reads as a function: tables(spark, dir).lineitem
    """``tables(spark, folder).orders`` is the table of that name; Catalyst prunes its columns and pushes its filters."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        """Register the tables as temporary views and return the session, for ``.sql``."""
        for name in names or TABLES:
            getattr(self, name).createOrReplaceTempView(name)
        return self._spark
