"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words, so each of its documents is expected target / source_size times. Documents
of a source stand in a fixed order, by size and then by a hash of the id; the running sum of their expected copies plus
one offset for the source crosses an integer 0, 1 or more times at each document, and that many copies are emitted.
Ordering by size strikes all lengths evenly, so the words taken come near the target.

Running sums don't need a source in one task: rows are range-partitioned by source, size and hash, partitions rank
their own rows, and the number of a source's rows in earlier partitions is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import checkpoint, parts_for, row_key, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"


def targets(by_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to one row a source (absent, name, source_size): shares of ``share`` times all sizes by weight, none above ``cap`` times its size.

    Sources in code point order, the null one last, have ``weights``, repeating. What the capped ones leave is shared
    again by weight among the others. That is the level at which sum(min(cap * size, weight * level)) is the total:
    with sources in order of cap over weight, the largest level that a prefix of capped sources leaves to the rest.
    """
    order = Window.orderBy(F.col("absent"), F.col("name"))  # one row a source
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)).withColumn("top", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), "absent", "name")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levels.select("absent", "name", "source_size", F.least(F.col("top"), F.col("weight") * F.col("level")).alias("target"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, seed: int = 0, key: F.Column | None = None,
) -> DataFrame:
    """One row for each input row: id, size (words), source_size and target of its source, copies, taken (copies * size), and ``key``.

    A null text has size 0; a null source is a source, last in order; a source of size 0 has target 0 and no copies. A
    null id sorts first among equal sizes; repeated rows are sampled each on its own. The result depends on rows and
    ``seed`` alone. An empty table gives an empty result. ``copies`` is at most ``cap`` rounded up.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("absent"), F.coalesce(F.col(source_col), F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.lit(None) if key is None else key).cast("string").alias("key"),
    ).withColumn("h", F.md5(F.col("id").cast("string")))
    rows = checkpoint(rows)
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), "absent", "name", "size", "h", "id")
    dealt = checkpoint(dealt.withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("absent", "name", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("absent", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("absent", "name", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # at most partitions + sources rows
    shares = targets(counts.groupBy("absent", "name").agg(F.sum("words").alias("source_size")), weights, share, cap)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("absent"), "").otherwise("="), F.col("name"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    plan = offsets.join(shares.withColumn("start", start), ["absent", "name"])
    own = F.row_number().over(Window.partitionBy("absent", "name", "part").orderBy("size", "h", "id"))
    ranked = dealt.withColumn("own", own).join(plan, ["absent", "name", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("before") + F.col("own")).cast("double")
    copies = F.floor(F.col("start") + rank * rate) - F.floor(F.col("start") + (rank - 1) * rate)
    out = ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.cast("long").alias("copies"), "key")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def resample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it.

    Rows that are alike in all columns are emitted as often as the mix takes all of them. Columns may have any names and
    types; an empty table gives an empty result.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*names.values())
    keyed = rows.withColumn("key", row_key(rows))
    copies = mix(keyed, names[id_col], names[text_col], names[source_col], key=F.col("key"), **options)
    copies = copies.filter("copies > 0").groupBy("key").agg(F.sum("copies").alias("copies"))
    taken = keyed.dropDuplicates(["key"]).join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*names.values()).toDF(*df.columns)
