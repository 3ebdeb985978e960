"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learned so that the signs of the rotated vectors, a binary code, lose as little as possible (iterative
quantisation), from a bounded sample; rotations from different starts give independent codes. Vectors of each length have
a model of their own. Every code is cut into substrings, each with its own table by label and substring. A vector probes
each table with its substring and all that differ from it in one bit; pairs that meet, and whose whole codes are near,
are confirmed by their cosine in double precision. A pair that several tables find counts in the first only. Copies of a
vector (same label, same components) are one class throughout.

No pair is ever a row. Tasks go through buckets twice, in order: by codes alone, which gives the members of a bucket that
are near any other; then, for those alone, with their vectors, which gives the number of links of each class that a
bucket holds and links enough to connect it. A bucket of many vectors is split: its probes are dealt to parts, each of
which has all vectors stored in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm._common import checkpoint, map_arrow, parts_for, shuffle_partitions
from gridloom.llm.graph import components

#: Vectors the rotations of a length are learned from, at most, and numbers in these.
SAMPLE, SAMPLE_NUMBERS = 20_000, 8_000_000
BITS, SUBSTRINGS, ROTATIONS, MOST_ROTATIONS = 64, 4, 2, 16
#: Vectors stored in one part of a bucket, and pairs worked out at once.
STORED, PAIRS = 512, 1 << 18
U64 = np.uint64


class Model(NamedTuple):
    dimension: int
    mean: np.ndarray
    planes: np.ndarray  # rotations x dimension x bits
    radius: int  # bits that the codes of a candidate pair differ in at most

    def cuts(self) -> list[tuple[int, int, int]]:
        """The tables: (rotation, first bit, bits)."""
        bits = self.planes.shape[2]
        substrings = min(SUBSTRINGS, bits)
        length = bits // substrings
        return [(r, s * length, length if s + 1 < substrings else bits - s * length) for r in range(len(self.planes)) for s in range(substrings)]


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, normalised vectors) of the valid rows of each length: not null, all finite, not zero."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(axis=1)
        fine = np.isfinite(top) & (top > 0)
        x = x[fine] / top[fine, None]
        yield rows[fine], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def found_share(differ: float, rotations: int, bits: int) -> float:
    """Chance that one table at least finds a pair whose codes differ in this share of the bits."""
    n = max(1, bits // min(SUBSTRINGS, bits))
    one = (1 - differ) ** n + n * differ * (1 - differ) ** (n - 1)
    return 1 - (1 - one) ** (min(SUBSTRINGS, bits) * rotations)


def learn(sample: np.ndarray, threshold: float, rotations: int = ROTATIONS, bits: int = BITS, iterations: int = 40, seed: int = 11) -> Model:
    """Iterative quantisation of normalised vectors: principal directions, then rotations that bring their signs close.

    Codes are taken around the mean, which widens the angle of two vectors where all share a direction: there are as
    many rotations, up to MOST_ROTATIONS, as find pairs at the threshold by 0.98, judged by the sample's distances from
    the mean.
    """
    n, dimension = sample.shape
    bits = min(bits, dimension)
    mean = sample.mean(axis=0) if n else np.zeros(dimension)
    centred = sample - mean
    spread = np.quantile((centred**2).sum(axis=1), 0.1) if n > 1 else 1.0
    differ = np.arccos(max(-1.0, 1 - (1 - threshold) / max(spread, 1e-9))) / np.pi
    while rotations < MOST_ROTATIONS and found_share(differ, rotations, bits) < 0.98:
        rotations += 1
    _, vectors = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(dimension))
    main = vectors[:, ::-1][:, :bits]
    projected, draw, planes = centred @ main, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(draw.standard_normal((bits, bits)))
        for _ in range(iterations if n > bits else 0):
            u, _, vt = np.linalg.svd(projected.T @ np.where(projected @ turn >= 0, 1.0, -1.0))
            turn = u @ vt
        planes.append(main @ turn)
    total = bits * rotations
    radius = min(total, int(np.ceil(total * differ + 4.5 * np.sqrt(total * differ * (1 - differ)) + 4)))
    return Model(dimension, mean, np.array(planes).reshape(rotations, dimension, bits), radius)


def codes(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Rows x rotations codes of up to 64 bits, as signed integers."""
    centred = vectors - model.mean
    weights = np.left_shift(np.uint64(1), np.arange(model.planes.shape[2], dtype=np.uint64))
    return np.stack([((centred @ p >= 0) * weights).sum(axis=1, dtype=np.uint64).view(np.int64) for p in model.planes], axis=1) if len(vectors) else np.zeros((0, len(model.planes)), np.int64)


def _learned(group: pa.Table, threshold: float, rotations: int, bits: int) -> pa.Table:
    """The model of one length, from its sample."""
    d = group.column("d")[0].as_py()
    vectors = [x for _, x in _units(group.column("v").combine_chunks())]
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    model = learn(vectors[0][:most] if vectors else np.zeros((0, d)), threshold, rotations, bits)
    return pa.table({"d": pa.array([d], pa.int32()), "rotations": pa.array([len(model.planes)], pa.int32()), "radius": pa.array([model.radius], pa.int32()), "mean": [model.mean.tobytes()], "planes": [model.planes.tobytes()]})


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], n: int, kind: pa.DataType) -> pa.Array:
    """A list array of n rows from (rows, matrix) parts; the other rows are null."""
    widths = np.zeros(n, np.int64)
    has = np.zeros(n, bool)
    for rows, matrix in parts:
        widths[rows], has[rows] = matrix.shape[1], True
    ends = np.concatenate([[0], np.cumsum(widths)])
    flat = np.zeros(ends[-1], parts[0][1].dtype if parts else np.int64)
    for rows, matrix in parts:
        flat[ends[rows][:, None] + np.arange(matrix.shape[1])] = matrix
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind), mask=pa.array(~has))


def _code(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        able = batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        label, n = batch.column("label").to_pylist(), batch.num_rows
        names, length, found, kept = [None] * n, np.zeros(n, np.int32), [], []
        for rows, unit in _units(batch.column("v")):
            own = able[rows]
            rows, unit = rows[own], unit[own]
            if not len(rows):
                continue
            model = models[unit.shape[1]]
            length[rows] = model.dimension
            found.append((rows, codes(unit, model)))
            kept.append((rows, unit))
            for i, x in zip(rows.tolist(), unit, strict=True):
                names[i] = hashlib.blake2b(repr(label[i]).encode() + x.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(names, pa.binary()), pa.array(length), _lists(found, n, pa.int64()), _lists(kept, n, pa.float64())], ["id", "label", "node", "d", "codes", "v"]
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _substring(code: np.ndarray, at: int, n: int) -> np.ndarray:
    return (code.view(U64) >> U64(at)) & U64((1 << n) - 1)


def _slots(batches: Iterator[pa.RecordBatch], models: dict[int, Model], home: bool) -> Iterator[pa.RecordBatch]:
    """A row for each bucket in which a class is stored (home), or for each that it probes."""
    for batch in batches:
        lengths = batch.column("d").to_numpy()
        for d in np.unique(lengths).tolist():
            model, own = models[d], np.flatnonzero(lengths == d)
            for start in range(0, len(own), 4096):
                rows = batch.take(pa.array(own[start : start + 4096]))
                code, group = _matrix(rows.column("codes")), rows.column("g").to_numpy().view(U64)
                for t, (r, at, n) in enumerate(model.cuts()):
                    key = _substring(code[:, r], at, n)
                    flips = np.array([0] if home else [0, *(1 << i for i in range(n))], U64)
                    with np.errstate(over="ignore"):
                        bucket = textnum.mix((key[:, None] ^ flips[None]) * U64(0x9E3779B97F4A7C15) + textnum.mix(group + U64(t + 1))[:, None])
                    many = pa.array(np.repeat(np.arange(len(rows)), len(flips)))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64).ravel()), rows.column("c").take(many), pa.array(np.full(len(many), t, np.int32))], ["bucket", "c", "t"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in bucket order with those stored first: (rows, probes, stored), pairs of row numbers that meet, at most PAIRS or one probe's at once."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        old = held.num_rows if held is not None else 0
        rows = rows.combine_chunks()
        bucket, salt, home = (rows.column(c).to_numpy() for c in ("bucket", "salt", "home"))
        change = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
        group = np.repeat(np.arange(len(change)), np.diff(np.concatenate([change, [len(rows)]])))
        stored = np.bincount(group[home], minlength=len(change))
        probes = np.flatnonzero(~home)
        probes = probes[probes >= old]
        ends, done = np.cumsum(stored[group[probes]]), 0
        while done < len(probes):
            before = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            own = probes[done:stop]
            n = stored[group[own]]
            a = np.repeat(own, n)
            b = np.repeat(change[group[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield rows, a, b
            done = stop
        last = np.flatnonzero(home & (group == len(change) - 1))
        held = rows.take(pa.array(last))


def _first(rows: pa.Table, a: np.ndarray, b: np.ndarray, models: dict[int, Model]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose codes are near and that no table before this one finds; each pair once (the lesser class probes)."""
    c, g, d, t = (rows.column(x).to_numpy() for x in ("c", "g", "d", "t"))
    fine = (c[a] < c[b]) & (g[a] == g[b])
    a, b, kept = a[fine], b[fine], []
    ends = rows.column("codes").chunk(0).offsets.to_numpy() if len(a) else None
    for length in np.unique(d[a]).tolist():
        model, own = models[length], np.flatnonzero(d[a] == length)
        flat = rows.column("codes").chunk(0).values.to_numpy()
        code = lambda x: flat[ends[x][:, None] + np.arange(len(model.planes))].view(U64)
        far = code(a[own]) ^ code(b[own])
        good = np.bitwise_count(far).sum(axis=1) <= model.radius
        for i, (r, at, n) in enumerate(model.cuts()):
            good &= (t[a[own]] <= i) | (np.bitwise_count(_substring(far[:, r], at, n)) > 1)
        kept.append(own[good])
    fine = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[fine], b[fine]


def _near(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """The rows that are near another of their bucket; a stored one may come more than once."""
    for rows, a, b in _met(batches):
        a, b = _first(rows, a, b, models)
        if len(a):
            some = rows.take(pa.array(np.unique(np.concatenate([a, b])))).select(["bucket", "salt", "home", "c", "t"])
            yield from some.to_batches()


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (x, y) connect: one for each node but the least of each component."""
    nodes, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, low = both[: len(x)], both[len(x) :], np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        then = low.copy()
        for at in (x, y, low[x], low[y]):
            np.minimum.at(then, at, least)
        then = then[then]
        if (then == low).all():
            break
        low = then
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def _linked(batches: Iterator[pa.RecordBatch], models: dict[int, Model], threshold: float) -> Iterator[pa.RecordBatch]:
    """(c, linked, other): how many rows a class is linked with in a bucket, and links that connect the bucket's classes."""
    for rows, a, b in _met(batches):
        a, b = _first(rows, a, b, models)
        if not len(a):
            continue
        column, c, copies, d = rows.column("v").chunk(0), rows.column("c").to_numpy(), rows.column("copies").to_numpy(), rows.column("d").to_numpy()
        ends, flat, near = column.offsets.to_numpy(), column.values.to_numpy(), np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 14):
            for length in np.unique(d[a[i : i + (1 << 14)]]).tolist():
                own = i + np.flatnonzero(d[a[i : i + (1 << 14)]] == length)
                v = lambda x: flat[ends[x][:, None] + np.arange(length)]
                near[own] = np.einsum("ij,ij->i", v(a[own]), v(b[own])) >= threshold
        a, b = a[near], b[near]
        if len(a):
            who, place = np.unique(np.concatenate([c[a], c[b]]), return_inverse=True)
            linked = np.bincount(place, np.concatenate([copies[b], copies[a]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(linked), pa.nulls(len(who), pa.int64())], ["c", "linked", "other"])
            x, y = spanning(c[a], c[b])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(y)], ["c", "linked", "other"])


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, bits: int = BITS, rotations: int = ROTATIONS, sample: int = SAMPLE,
) -> DataFrame:
    """One row for each input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows are linked if their labels are equal and not null, their vectors are of one length and their cosine is
    ``threshold`` or more. Rows with a null label or id, and vectors that are null, empty or zero or hold null or
    non-finite components, link with nothing: n_links 0, component_id their own id, kept true. Repeated rows are copies
    and count each. An empty table gives an empty result; other columns are not read. The rotations of a length are
    learned from some ``sample`` of its vectors at most; all rows are indexed. Index: a pair at the threshold is found
    with probability 0.98 or more (two codes of 64 bits, four substrings each; more codes where vectors share a
    direction), at cosine 0.97 with 0.9997; no pair below the threshold is linked.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds, spark = dict(rows.dtypes), df.sparkSession
    size = F.size("v").alias("d")
    lengths = rows.filter("size(v) > 0").groupBy(size).agg(F.count("*").alias("n")).withColumn("most", F.least(F.lit(sample), F.lit(SAMPLE_NUMBERS) / F.col("d")))
    drawn = rows.filter("size(v) > 0").withColumn("d", size).join(lengths, "d").filter(F.pmod(F.xxhash64("id", "v"), F.col("n")) < F.col("most")).select("d", "v")
    learned = drawn.groupBy("d").applyInArrow(lambda g: _learned(g, threshold, rotations, bits), "d int, rotations int, radius int, mean binary, planes binary")
    models = {}
    for r in learned.collect():  # a model a length
        models[r.d] = Model(r.d, np.frombuffer(r.mean), np.frombuffer(r.planes).reshape(r.rotations, r.d, -1), r.radius)
    for r in lengths.collect():  # lengths whose sample is empty by chance
        models.setdefault(r.d, learn(np.zeros((0, r.d)), threshold, rotations, bits))
    coded = checkpoint(map_arrow(rows, partial(_code, models=models), f"id {kinds['id']}, label {kinds['label']}, node binary, d int, codes array<long>, v array<double>"))
    found = coded.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("d").alias("d"), F.first("codes").alias("codes"), F.first("v").alias("v"))
    classes = checkpoint(found.withColumn("g", F.xxhash64("label", "d")).drop("label").withColumn("c", F.monotonically_increasing_id()), parts_for(spark, coded.count(), 1 << 12))
    n_classes = classes.count()
    short = partial(checkpoint, parts=parts_for(spark, n_classes * len(max((m.cuts() for m in models.values()), key=len, default=[()]))))
    marks = classes.select("c", "g", "d", "codes")
    slots = lambda home: map_arrow(marks, partial(_slots, models=models, home=home), "bucket long, c long, t int")
    parts = shuffle_partitions(spark)
    stored = short(slots(True))
    buckets = short(stored.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("salts", F.least(F.lit(parts), F.ceil(F.col("n") / STORED)).cast("int")))
    large = buckets.filter("salts > 1").select("bucket", F.col("salts").alias("split"))
    share = (buckets.agg(F.sum("n")).first()[0] or 0) / (4 * parts)
    hot = buckets.filter(F.col("n") > share).select("bucket", F.lit(parts).alias("deal"))  # fewer than 4 * parts rows
    # Probes of empty buckets go; those of a hot bucket are dealt among as many tasks as there are partitions to find that out.
    asked = slots(False).join(F.broadcast(hot), "bucket", "left").withColumn("deal", F.pmod(F.xxhash64("c"), F.coalesce("deal", F.lit(1))))
    dealt = buckets.withColumn("deal", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, parts).otherwise(1) - 1)))
    asked = asked.join(dealt.select("bucket", "deal", "salts"), ["bucket", "deal"]).select("bucket", F.pmod(F.xxhash64("c"), "salts").cast("int").alias("salt"), F.lit(False).alias("home"), "c", "t")
    own = stored.join(large, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), F.coalesce("split", F.lit(1)) - 1)).alias("salt"), F.lit(True).alias("home"), "c", "t")
    order = ["bucket", "salt", F.desc("home")]
    met = own.union(asked).join(marks, "c").repartition("bucket", "salt").sortWithinPartitions(*order)
    near = short(map_arrow(met.select("bucket", "salt", "home", "c", "t", "g", "d", "codes"), partial(_near, models=models), "bucket long, salt int, home boolean, c long, t int").distinct())
    full = near.join(classes.select("c", "g", "d", "codes", "copies", "v"), "c").repartition("bucket", "salt").sortWithinPartitions(*order)
    made = short(map_arrow(full.select("bucket", "salt", "home", "c", "t", "g", "d", "codes", "copies", "v"), partial(_linked, models=models, threshold=threshold), "c long, linked long, other long"))
    placed = components(made.filter("other IS NOT NULL").select("c", "other"), parts_for(spark, n_classes))
    linked = made.filter("linked IS NOT NULL").groupBy("c").agg(F.sum("linked").alias("linked"))
    named = classes.select("c", "node", "low", "copies").join(placed.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    done = named.join(lowest, "component").join(linked, "c", "left").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = coded.select("id", "node").join(done, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
