"""Where rows come from and go to."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")
COMPRESSION = {"none": "uncompressed", "zlib": "zlib", "snappy": "snappy", "lzo": "lzo", "zstd": "zstd", "lz4": "lz4", "gzip": "gzip"}


def scan(spark: SparkSession, path: str, columns: Sequence[str] = (), filters: Sequence[str] = (), remaining: str | None = None, kind: str = "parquet", schema: str | None = None, file_column: str | None = None) -> DataFrame:
    """A scan of files with the columns and filters that the reader can use; partition folders become columns.

    ``filters`` are conjuncts on single columns, which reach the file reader; ``remaining`` is any further predicate.
    ``file_column`` names a synthesized column with each row's file.
    """
    if kind not in FORMATS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(FORMATS)}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    df = (reader.schema(schema) if schema else reader).load(path)
    if file_column:
        df = df.withColumn(file_column, F.col("_metadata.file_path"))
    for text in filters:
        df = df.filter(text)
    if remaining:
        df = df.filter(remaining)
    return df.select(*columns, *([file_column] if file_column and columns else [])) if columns else df


def values(spark: SparkSession, rows: Sequence[tuple], schema: str, times: int = 1) -> DataFrame:
    """Rows in memory, ``times`` over."""
    df = spark.createDataFrame(list(rows), schema)
    return df if times == 1 else df.crossJoin(spark.range(times).drop("id"))


def arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Rows of an Arrow table."""
    return spark.createDataFrame(table)


def write(
    df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition: Sequence[str] = (), compression: str | None = None, overwrite_partitions: str = "static", sort: Sequence[str] = ()
) -> DataFrame:
    """Write files and return one row: how many rows there now are below ``path``. mode: error, append, overwrite or ignore.

    ``overwrite_partitions='dynamic'`` replaces only the partitions that the rows have.
    """
    if sort:
        df = df.sortWithinPartitions(*partition, *sort)
    writer = df.write.format(kind).mode(mode).option("partitionOverwriteMode", overwrite_partitions)
    if compression:
        writer = writer.option("compression", COMPRESSION[compression])
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition) if partition else writer).save(path)
    return scan(df.sparkSession, path, kind=kind).agg(F.count("*").alias("rows"))


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str], sort: Sequence[str] = (), mode: str = "overwrite", path: str | None = None) -> DataFrame:
    """Write a table whose rows are dealt to buckets by a hash of keys, so that later joins on the keys need no shuffle.

    Its files go to ``path``, or the warehouse.
    """
    writer = df.write.mode(mode).format("parquet").bucketBy(buckets, *keys)
    if path:
        writer = writer.option("path", path)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def deliver(df: DataFrame):
    """Rows one by one to a consumer on the driver, a partition in memory at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def generate(spark: SparkSession, rows: int, partitions: int = 8, seed: int = 1) -> DataFrame:
    """Order lines made on the fly, the same for the same seed: a source without files for benches and examples."""
    at = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(at, F.lit(seed), F.lit(salt)), F.lit(n))
    return spark.range(rows, numPartitions=partitions).select(
        (at / 4).cast("long").alias("l_orderkey"), (draw(1, 20_000) + 1).alias("l_partkey"), (draw(2, 1_000) + 1).alias("l_suppkey"), (at % 4 + 1).cast("int").alias("l_linenumber"),
        (draw(3, 50) + 1).cast("double").alias("l_quantity"), (draw(4, 10_000_000) / 100).alias("l_extendedprice"), (draw(5, 11) / 100).alias("l_discount"), (draw(6, 9) / 100).alias("l_tax"),
        F.element_at(F.array(*map(F.lit, "ANR")), (draw(7, 3) + 1).cast("int")).alias("l_returnflag"), F.element_at(F.array(*map(F.lit, "FO")), (draw(8, 2) + 1).cast("int")).alias("l_linestatus"),
        F.timestamp_seconds(F.lit(788918400) + draw(9, 2_500) * 86400).alias("l_shipdate"),
    )
