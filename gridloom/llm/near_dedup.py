"""MinHash near-duplicate detection with odd sketches.

Each text becomes the set of its distinct word shingles. Texts with equal sets fall into one class first, so groups of
copies cost one row in what follows. A class has MinHash values in bands of rows, and an odd sketch: its MinHash
values folded into a parity bitmap. The number of set bits in the XOR of two sketches estimates their similarity,
most precisely near 1, for a few bytes a class. Candidates share a band; a sketch that puts a pair far below the
threshold drops it; the full sets confirm all others.

Classes in one bucket are not paired with each other. In each round every bucket has one leader and its other classes
are checked against that; a bucket whose classes are all in one component is done. The leader is the class that shares
most buckets with most others, the centre of a group of edited copies; in later rounds, the one of a component that has
not led. Buckets that hold several components after ``rounds`` rounds are compared in blocks: sketches first, which tell
the classes that may be linked with another component at all, then the sets of those.

A bucket with more than its share of all rows is split: its rows are dealt by class among as many tasks as the shuffle
has partitions. There are fewer than four such buckets a partition, so a list of them is small whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm._common import checkpoint, map_arrow, parts_for, shuffle_partitions, slices
from gridloom.llm.graph import components

BANDS, ROWS, SKETCH_BITS = 24, 4, 256
#: Classes that one copy of a leader's set meets; classes of a bucket in one block of the comparison by sketches.
CHUNK, SKETCHES = 256, 256
#: Shingles of a bucket in one block of the comparison by sets.
BLOCK_SHINGLES = 1 << 17
U64 = np.uint64


def _minhash(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, U64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        np.minimum(least, (factors[:, None] * part[None, :] + shifts[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(values: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of (position, MinHash value) pairs, as 64-bit words."""
    spots = (textnum.mix(values ^ textnum.seeds(len(values), 5)) % U64(bits)).astype(np.int64)
    parity = (np.bincount(spots, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketch_distance(similarity: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> float:
    """Expected number of bits in the XOR of the odd sketches of two sets of this similarity."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    factors, shifts = textnum.seeds(bands * rows, 3) | U64(1), textnum.seeds(bands * rows, 4)
    salt = textnum.seeds(bands, 6)
    for batch in slices(batches, "text", textnum.BLOCK_BYTES):
        sets = textnum.shingle_sets(*textnum.word_hashes(batch.column("text")), size)
        nodes, sketches, keys = [], [], []
        with np.errstate(over="ignore"):
            for x in sets:
                nodes.append(_node(x))
                if len(x):
                    values = _minhash(x, factors, shifts)
                    sketches.append(odd_sketch(values).tolist())
                    band = values.reshape(bands, rows)
                    keys.append(textnum.mix((band * factors[:rows]).sum(axis=1) + salt).view(np.int64).tolist())
                else:
                    sketches.append(None)
                    keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(nodes, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "node", "n", "sketch", "keys"],
        )


def _node(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        one, two = textnum.mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(), textnum.mix(shingles * U64(0xD6E8FEB86659FD93) + U64(len(shingles))).sum()
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", textnum.BLOCK_BYTES):
        sets = textnum.shingle_sets(*textnum.word_hashes(batch.column("text")), size)
        yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def _far(a: str, b: str) -> F.Column:
    """Bits in the XOR of two odd sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _copies(n: F.Column) -> F.Column:
    """0 to n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _buckets(classes: DataFrame) -> tuple[DataFrame, F.Column, int]:
    """(key, salt, c, members) of all classes in buckets of two or more; how many salts a bucket of so many members has; rows in all."""
    spark = classes.sparkSession
    parts = shuffle_partitions(spark)
    spread = classes.select("c", F.explode("keys").alias("key"))
    shared = checkpoint(spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), parts_for(spark, classes.count()))
    total = shared.agg(F.sum("members")).first()[0] or 0
    share = total / (4 * parts)
    salts = F.when(F.col("members") > share, F.lit(parts)).otherwise(F.lit(1))
    large = shared.filter(F.col("members") > share).select("key", F.lit(parts).alias("salts"))  # fewer than 4 * parts rows
    dealt = spread.join(F.broadcast(large), "key", "left").withColumn("salt", F.pmod(F.xxhash64("c"), F.coalesce("salts", F.lit(1)))).select("key", "salt", "c")
    return checkpoint(dealt.join(shared.withColumn("salt", _copies(salts)), ["key", "salt"]), parts_for(spark, total)), salts, total


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
    bands: int = BANDS, rows: int = ROWS, slack: float = 0.3, rounds: int = 2,
) -> DataFrame:
    """Group texts that are linked, directly or through others, by a Jaccard similarity of ``threshold`` or more.

    One row for each input row: id, n_shingles (size of its set), component_id (smallest id reachable, itself
    included), kept (it is that smallest id). Words are runs of bytes other than ASCII white space, A-Z lowered; the
    set has all runs of ``size`` words, or all words as one run if there are fewer. Null and blank texts have an empty
    set and are linked with nothing. A row with a null id is linked with nothing: its component_id is null, and it is
    kept. Rows that repeat an id and a text repeat the result. An empty table gives an empty result. Other columns of
    ``df`` are not read.

    A pair of similarity ``threshold`` shares no band with probability (1 - threshold ** rows) ** bands, 3e-6 at the
    defaults; ``slack`` is how far below the threshold a sketch's estimate must lie to drop a pair (over five of its
    standard deviations at the default). Links are confirmed on full sets, in integers.
    """
    ratio = Fraction(threshold).limit_denominator(10_000)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = checkpoint(map_arrow(texts, partial(_signatures, size=size, bands=bands, rows=rows), f"id {dict(texts.dtypes)['id']}, node binary, n long, sketch array<long>, keys array<long>"))
    found = signed.filter("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    spark = df.sparkSession
    classes = checkpoint(found.withColumn("c", F.monotonically_increasing_id()), parts_for(spark, signed.count()))  # the numbers are those in the files
    buckets, salts, total = _buckets(classes)
    parts = parts_for(spark, total)  # of what is made of the buckets
    small = partial(checkpoint, parts=parts)
    active = small(buckets.groupBy("c").agg(F.sum("members").alias("weight")))
    own = classes.join(active, "c")
    sets = small(
        map_arrow(texts.join(own.select(F.col("low").alias("id")).distinct(), "id", "left_semi").select("text"), partial(_sets, size=size), "node binary, shingles array<long>")
        .filter("node IS NOT NULL").join(own.select("node", "c"), "node").groupBy("c").agg(F.first("shingles").alias("shingles"))
    )
    marks = small(own.select("c", "n", "sketch"))
    # Ties are broken by a hash; where that ties too, any class may lead.
    rank = F.shiftleft(F.col("weight"), 20).bitwiseOR(F.xxhash64("c").bitwiseAND(F.lit((1 << 20) - 1)))
    most = sketch_distance(max(0.0, threshold - slack))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that are links; the leaders are a.

        A leader meets as many classes as its bucket has, so its sketch and set are laid out ``copies`` times, once for
        each CHUNK of them, and its pairs are dealt among those.
        """
        pairs = small(pairs.groupBy("a", "b").agg(F.max("copies").alias("copies")).withColumn("copy", F.pmod(F.xxhash64("b"), "copies")))
        heads = pairs.select("a", "copies").distinct()
        on = ["a", "copies", "copy"]
        near = (
            pairs.join(marks.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .join(heads.join(marks.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").select("a", "copies", "na", "sa", _copies(F.col("copies")).alias("copy")), on)
            .filter(F.least("na", "nb") * ratio.denominator >= F.greatest("na", "nb") * ratio.numerator).filter(_far("sa", "sb") <= most).select(*on, "b", "na", "nb")
        )
        leads = heads.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("xa")), "a").select("a", "copies", "xa", _copies(F.col("copies")).alias("copy"))
        both = near.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("xb")), "b").join(leads, on)
        common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).cast("long").alias("common"))
        return common.filter(F.col("common") * ratio.denominator >= (F.col("na") + F.col("nb") - F.col("common")) * ratio.numerator).select("a", "b")

    # Open buckets: (key, salt, c, members, rank, led); after the first round also component.
    open_ = small(buckets.join(active, "c").select("key", "salt", "c", "members", rank.alias("rank"), F.lit(False).alias("led")))
    led = open_.groupBy("key").agg(F.first("members").alias("members"), F.max_by("c", "rank").alias("lead"), F.lit(None).cast("long").alias("of"))
    links, placed = None, None
    for turn in range(rounds):
        led = small(led.withColumn("salt", _copies(salts)).drop("members"))
        met = open_.join(led, ["key", "salt"])
        apart = F.col("c") != F.col("lead") if turn == 0 else F.col("component") != F.col("of")
        fresh = small(confirmed(met.filter(apart).select(F.col("lead").alias("a"), F.col("c").alias("b"), F.ceil(F.col("members") / CHUNK).alias("copies"))))
        links = fresh if links is None else links.union(fresh)
        placed = small(components(links, parts))
        # A bucket of two is done: its leader was compared with the other.
        now = open_.drop("component").join(led, ["key", "salt"]).filter("members > 2").select("key", "salt", "c", "members", "rank", (F.col("led") | (F.col("c") == F.col("lead"))).alias("led"))
        now = small(now.join(placed.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")))
        groups = now.groupBy("key", "component").agg(F.first("members").alias("members"), F.count("*").alias("here"), F.max_by("c", "rank").alias("lead"), F.max("rank").alias("rank"), F.max("led").alias("led"))
        fresh_rank = F.when(~F.col("led"), F.col("rank"))
        led = small(groups.groupBy("key").agg(F.first("members").alias("members"), F.count("*").alias("several"), F.max_by("lead", fresh_rank).alias("lead"), F.max_by("component", fresh_rank).alias("of")).filter("several > 1"))
        open_ = small(now.join(led.select("key", _copies(salts).alias("salt")), ["key", "salt"]))
        led = led.drop("several").filter("lead IS NOT NULL")
        if open_.isEmpty():
            break
    else:
        links = links.union(small(_rest(open_, marks, sets, salts, ratio, most, parts)))
        placed = components(links, parts)
    of_class = classes.select("c", "node", "low").join(placed.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    named = of_class.join(lowest, "component").select("node", "component_id")
    return signed.join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("component_id", "id"))).alias("kept"),
    )


def _blocks(rows: DataFrame, blocks: str, columns: list[str]) -> DataFrame:
    """Deal the rows of each key to ``blocks`` blocks; every two of them meet as one group (key, i, j)."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("c"), blocks)).withColumn("other", _copies(F.col(blocks)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)


def _rest(open_: DataFrame, marks: DataFrame, sets: DataFrame, salts: F.Column, ratio: Fraction, most: float, parts: int) -> DataFrame:
    """Links between different components of one bucket.

    Blocks of sketches tell which classes may be linked with one of another component at all, a row a class. Only the
    sets of those travel, once for each block of their bucket, and every two blocks meet in one task, which gives links.
    """
    side = open_.join(marks, "c").withColumn("blocks", F.ceil(F.col("members") / SKETCHES)).select("key", "members", "c", "component", "n", "sketch", "blocks")
    able = _blocks(side, "blocks", ["members", "c", "component", "n", "sketch"]).groupBy("key", "i", "j").applyInArrow(lambda g: _able(g, ratio, most), "key long, members long, c long, n long, component long")
    able = checkpoint(able.groupBy("key", "c").agg(F.first("members").alias("members"), F.first("n").alias("n"), F.first("component").alias("component")), parts)
    sizes = able.groupBy("key").agg(F.first("members").alias("members"), F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / SKETCHES)).alias("blocks"))
    sizes = checkpoint(sizes.select("key", "blocks", _copies(salts).alias("salt")), parts)
    dealt = checkpoint(able.withColumn("salt", F.pmod(F.xxhash64("c"), salts)).join(sizes, ["key", "salt"]).select("key", "c", "component", "n", "blocks"), parts).join(sets, "c")
    return _blocks(dealt, "blocks", ["c", "component", "n", "shingles"]).groupBy("key", "i", "j").applyInArrow(lambda g: _compare(g, ratio), "a long, b long")


def _able(group: pa.Table, ratio: Fraction, most: float) -> pa.Table:
    """The classes of a group that sizes and sketches don't keep from a link with another component."""
    n, component = group.column("n").to_numpy(), group.column("component").to_numpy()
    sketch = np.array(group.column("sketch").combine_chunks().flatten()).view(U64).reshape(len(n), -1)
    found = np.zeros(len(n), bool)
    for a in range(0, len(n), CHUNK):
        for b in range(a, len(n), CHUNK):
            x, y = slice(a, a + CHUNK), slice(b, b + CHUNK)
            far = sum(np.bitwise_count(sketch[x, None, i] ^ sketch[None, y, i]).astype(np.int32) for i in range(sketch.shape[1]))
            low, high = np.minimum(n[x, None], n[None, y]), np.maximum(n[x, None], n[None, y])
            near = (far <= most) & (component[x, None] != component[None, y]) & (low * ratio.denominator >= high * ratio.numerator)
            found[x] |= near.any(axis=1)
            found[y] |= near.any(axis=0)
    return group.filter(pa.array(found)).select(["key", "members", "c", "n", "component"])


def _compare(group: pa.Table, ratio: Fraction) -> pa.Table:
    """Links of a group's classes, one for each class and other component: common shingles by products of 0-1 matrices."""
    n, c = group.column("n").to_numpy(), group.column("c").to_numpy()
    _, component = np.unique(group.column("component").to_numpy(), return_inverse=True)
    column = group.column("shingles").combine_chunks()
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    owner = np.repeat(np.arange(len(n)), np.diff(ends))
    _, kind, times = np.unique(np.asarray(column.flatten()), return_inverse=True, return_counts=True)
    shared = times[kind] > 1
    owner, (_, kind) = owner[shared], np.unique(kind[shared], return_inverse=True)
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for top in range(0, len(n), CHUNK):
        rows = slice(top, top + CHUNK)
        common = np.zeros((min(CHUNK, len(n) - top), len(n)), np.float32)
        for start in range(0, int(kind.max(initial=-1)) + 1, 2048):
            own = slice(*np.searchsorted(kind, [start, start + 2048]))
            has = np.zeros((len(n), 2048), np.float32)
            has[owner[own], kind[own] - start] = 1
            common += has[rows] @ has.T
        both = common.astype(np.int64)
        near = (both * ratio.denominator >= (n[rows, None] + n[None] - both) * ratio.numerator) & (component[rows, None] != component[None])
        x, y = np.nonzero(near)
        _, first = np.unique(x * (component.max(initial=0) + 1) + component[y], return_index=True)
        a.append(c[rows][x[first]])
        b.append(c[y[first]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})
