"""Writers: what was written is read again and compared."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from gridloom import sources
from gridloom.catalog import tables

QUERIES = {}


def _folder(spark) -> str:
    """A new folder where executors and driver can both write: below the checkpoint folder; a local session may do without one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        return path
    return f"{shared.rstrip('/')}/written-{uuid.uuid4().hex}"


def _written(kind: str, compression: str | None):
    def build(spark, sf_dir):
        rows, path = tables(spark, sf_dir).supplier, f"{_folder(spark)}/supplier"
        sources.write(rows, path, kind=kind, compression=compression)
        back = sources.scan(spark, path, kind=kind, schema="s_suppkey long, s_name string, s_nationkey int, s_acctbal double" if kind in ("csv", "json") else None)
        return back.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    return build


for _kind, _compression in (("parquet", "zstd"), ("orc", "zlib"), ("csv", None), ("json", "gzip")):
    QUERIES[f"sink_{_kind}"] = (_written(_kind, _compression), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def partitioned(spark, sf_dir):
    """A partitioned write, then one that replaces the partitions it has and leaves the others."""
    t, path = tables(spark, sf_dir), f"{_folder(spark)}/orders"
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    sources.write(rows, path, partition=["o_orderstatus"], sort=["o_orderkey"])
    sources.write(rows.filter("o_orderstatus = 'F' AND o_orderkey % 10 = 0"), path, mode="overwrite", partition=["o_orderstatus"], overwrite_partitions="dynamic")
    return sources.scan(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES["sink_partitioned"] = (partitioned, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 10 = 0 GROUP BY o_orderstatus")


def appended(spark, sf_dir):
    t, path = tables(spark, sf_dir), f"{_folder(spark)}/nation"
    sources.write(t.nation, path)
    return sources.write(t.nation, path, mode="append")


QUERIES["sink_append"] = (appended, "SELECT 2 * count(*) AS rows FROM nation")


def bucketed(spark, sf_dir):
    """Two tables in the same buckets join without a shuffle."""
    t, folder, name = tables(spark, sf_dir), _folder(spark), uuid.uuid4().hex
    orders = sources.write_bucketed(t.orders.select("o_orderkey", "o_custkey"), f"orders_{name}", 8, ["o_custkey"], ["o_custkey"], path=f"{folder}/orders")
    customers = sources.write_bucketed(t.customer.select("c_custkey", "c_mktsegment"), f"customers_{name}", 8, ["c_custkey"], ["c_custkey"], path=f"{folder}/customers")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


QUERIES["sink_bucketed"] = (bucketed, "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
