"""What the operators share: the shared folder, checkpoints, Arrow batches of bounded bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python worker; a row that is larger travels alone.
BATCH_BYTES = 4 << 20
#: Seconds between two requests to collect the driver's garbage.
COLLECT_SECONDS = 2.0
_collected = 0.0
#: Rows of a few numbers in one partition of a small frame.
ROWS_A_PART = 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound what a Python worker holds of its input by bytes, not only by rows.

    The setting is read when a frame is executed, so it stays; a lower one of the session's owner stays too.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the session's owner has set as checkpoint folder.

    Where neither is set, a local session (driver and executors are one process) gets a folder of its own; on a cluster
    that is an error, as executors would not see each other's files.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{place}")
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def checkpoint(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut lineage with files in the shared folder, which outlive executors: a file a partition, in at most ``parts``.

    Spark deletes the shuffle and checkpoint files of frames that are no longer used when the driver's garbage is
    collected, which a driver with little to do may put off for long: so it is asked for here, every few seconds at most.
    """
    global _collected
    shared_dir(df.sparkSession)
    if time.monotonic() - _collected > COLLECT_SECONDS:
        df.sparkSession.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int, each: int = ROWS_A_PART) -> int:
    """Partitions for so many short rows: as few as hold ``each`` rows, up to the session's number. Small files cost more to make than to fill."""
    return max(1, min(shuffle_partitions(spark), -(-int(rows) // each)))


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which Spark's file system deletes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, system = _hadoop(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place, system = _hadoop(spark, path)
    system.delete(place, True)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def row_key(df: DataFrame) -> F.Column:
    """128 bits of all columns of a row, whatever their types and names; maps count by their entries' order."""
    columns = [F.to_json(F.struct(c)) if "map<" in kind or kind in ("variant", "void") else c for c, kind in ((F.col(f"`{n.replace('`', '``')}`"), t) for n, t in df.dtypes)]
    return F.concat(F.hex(F.xxhash64(F.lit(1), *columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *columns, F.lit(3))))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` of each has at most ``most`` bytes, or one row; empty ones go."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return memory that is free to the system: idle Python workers stay alive, each with the most it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _tidy(batches: Iterator[pa.RecordBatch], function: Callable, after: Callable[[], None] | None) -> Iterator[pa.RecordBatch]:
    try:
        yield from function(batches)
    finally:
        if after:
            after()
        give_back()


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes; ``after`` runs at the end of each task, then free memory is returned."""
    arrow_limits(df.sparkSession)
    return df.mapInArrow(partial(_tidy, function=function, after=after), schema)


def has_letter(column: str) -> F.Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def filesystem(path: str):
    """The file system of a path of the shared folder, from any executor, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)


def write_file(folder: str, name: str, data: Iterator[bytes]) -> str:
    """Write a file of the shared folder whole: under a name of this attempt's own, so that retries don't meet."""
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{place}/{path}") as out:
        for part in data:
            out.write(part)
    return f"{folder}/{path}"


def spread_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """One partition for each value 0..n-1 of ``column``."""
    return df.repartitionById(n, F.col(column).cast("int"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
