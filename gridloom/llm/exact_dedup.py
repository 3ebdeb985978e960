"""Exact deduplication through an extendible-hash index in shared files.

The 64-bit key space is cut into ranges; one owner task each. Tasks that read texts first collapse the copies in a
batch, so a group of copies costs its owner one row a batch. An owner takes its rows in key order, compares the bytes
of all texts with one key, chains those that differ, and inserts one entry a text into its index: a directory of
2**depth page numbers, addressed by the low bits of the key. A full page splits; if its local depth is the
directory's, the directory doubles. Pages whose keys are all one key can't split and chain into overflow pages. Each
index is one file of the shared folder; the result is a join of the rows' keys and digests with what the files hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import filesystem, fresh_dir, map_arrow, shuffle_partitions, spread_by, write_file

MAGIC = b"GLEHIDX1"
PAGE = struct.Struct("<II")  # local depth, entries
ENTRY = struct.Struct("<Q32s?qqq")  # key, SHA-256, has an id, id kept, rows, bytes
FOOTER = struct.Struct("<QIQQI8s")  # directory offset, depth, pages, entries, CRC-32 of the directory, magic


class ExtendibleHash:
    """Entries by 64-bit key; ``capacity`` entries a page."""

    def __init__(self, capacity: int = 64):
        self.capacity, self.depth, self.directory = capacity, 0, [0]
        self.pages: list[tuple[int, list]] = [(0, [])]

    def insert(self, key: int, value: tuple) -> None:
        while True:
            number = self.directory[key & ((1 << self.depth) - 1)]
            local, entries = self.pages[number]
            if len(entries) < self.capacity or all(k == key for k, _ in entries):
                entries.append((key, value))  # with one key only, the page grows: an overflow chain
                return
            self._split(number, key)

    def _split(self, number: int, key: int) -> None:
        """Split the page that ``key`` falls on, in two by the next bit; the directory doubles if it has no slot for that bit."""
        local, entries = self.pages[number]
        if local == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << local
        self.pages[number] = (local + 1, [e for e in entries if not e[0] & bit])
        self.pages.append((local + 1, [e for e in entries if e[0] & bit]))
        for i in range(key & (bit - 1) | bit, len(self.directory), bit << 1):
            self.directory[i] = len(self.pages) - 1

    def lookup(self, key: int) -> list[tuple]:
        """All values under a key: more than one if different texts share it."""
        return [v for k, v in self.pages[self.directory[key & ((1 << self.depth) - 1)]][1] if k == key]

    def dump(self) -> Iterator[bytes]:
        yield MAGIC
        at, offsets, total = len(MAGIC), [], 0
        for local, entries in self.pages:
            offsets.append(at)
            page = PAGE.pack(local, len(entries)) + b"".join(ENTRY.pack(k, *v) for k, v in entries)
            at, total = at + len(page), total + len(entries)
            yield page
        directory = struct.pack(f"<{len(self.directory)}Q", *(offsets[p] for p in self.directory))
        yield directory
        yield FOOTER.pack(at, self.depth, len(self.pages), total, zlib.crc32(directory), MAGIC)

    @classmethod
    def load(cls, path: str) -> ExtendibleHash:
        system, place = filesystem(path)
        with system.open_input_file(place) as source:
            data = source.read()
        at, depth, pages, total, crc, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        directory = data[at : at + (8 << depth)]
        if magic != MAGIC or data[:8] != MAGIC or zlib.crc32(directory) != crc:
            raise ValueError(f"{path} is not a whole index file")
        index, numbers = cls(), {}
        index.depth, index.pages, index.directory = depth, [], []
        for offset in struct.unpack(f"<{1 << depth}Q", directory):
            if offset not in numbers:
                numbers[offset] = len(index.pages)
                local, n = PAGE.unpack_from(data, offset)
                rows = ENTRY.iter_unpack(data[offset + PAGE.size : offset + PAGE.size + n * ENTRY.size])
                index.pages.append((local, [(k, tuple(v)) for k, *v in rows]))
            index.directory.append(numbers[offset])
        if len(index.pages) != pages or sum(len(e) for _, e in index.pages) != total:
            raise ValueError(f"{path} lacks pages")
        return index


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a batch: the largest id, and how many rows have it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, text = batch.column("key").to_numpy(), batch.column("text")
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        same = pc.equal(text, text.take(pa.array(first[group]))).to_numpy(zero_copy_only=False)
        if not same.all():  # another text with the key of the first: it stays a row of its own
            odd = np.flatnonzero(~same)
            group = group.copy()
            group[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("id"), 0).to_numpy()
        lowest = np.iinfo(np.int64).min
        largest, has = np.full(len(first), lowest), np.zeros(len(first), bool)
        np.maximum.at(largest, group[known], ids[known])
        has[group[known]] = True
        rows = batch.take(pa.array(first))
        yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("text"), pa.array(largest, mask=~has), pa.array(np.bincount(group, minlength=len(first)).astype(np.int64))], ["key", "text", "keep_id", "n"])


def _own(batches: Iterator[pa.RecordBatch], folder: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Build and write the index of one key range from rows in key order."""
    index, chain, now, longest = ExtendibleHash(capacity), [], None, 0

    def close() -> None:
        for text, keep, n in chain:
            index.insert(now & 0xFFFFFFFFFFFFFFFF, (hashlib.sha256(text).digest(), keep is not None, keep or 0, n, len(text)))

    for batch in batches:
        for key, text, keep, n in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "keep_id", "n")), strict=True):
            if key != now:
                close()
                chain, now = [], key
            for link in chain:
                if link[0] == text:
                    link[1] = keep if link[1] is None else link[1] if keep is None else max(link[1], keep)
                    link[2] += n
                    break
            else:
                chain.append([text, keep, n])
                longest = max(longest, len(chain))
    close()
    total = sum(len(e) for _, e in index.pages)
    if total:
        path = write_file(folder, "range", index.dump())
        rows = sum(v[3] for _, entries in index.pages for _, v in entries)
        yield pa.RecordBatch.from_pydict({"path": [path], "depth": [index.depth], "pages": [len(index.pages)], "entries": [total], "rows": [rows], "longest_chain": [longest]}, schema=_MANIFEST)


_MANIFEST = pa.schema([("path", pa.string()), ("depth", pa.int64()), ("pages", pa.int64()), ("entries", pa.int64()), ("rows", pa.int64()), ("longest_chain", pa.int64())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = [(k - (1 << 64) if k >> 63 else k, v) for _, page in ExtendibleHash.load(path).pages for k, v in page]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([v[0].hex() for _, v in rows], pa.string()), pa.array([v[2] if v[1] else None for _, v in rows], pa.int64()), pa.array([v[3] for _, v in rows], pa.int64())],
                ["key", "text_sha256", "keep_id", "group_size"],
            )


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64, owners: int | None = None, key: F.Column | None = None) -> DataFrame:
    """Write the index of all texts and return its manifest: one row (path, depth, pages, entries, rows, longest_chain) a file."""
    spark = df.sparkSession
    owners = owners or shuffle_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text") if key is None else key)
    found = map_arrow(rows, _collapse, "key long, text string, keep_id long, n long")
    owner = (F.shiftrightunsigned("key", 40) * owners) / F.lit(1 << 24)  # the key's place among all unsigned keys
    dealt = spread_by(found.withColumn("owner", F.floor(owner)), "owner", owners).drop("owner").sortWithinPartitions("key")
    made = dealt.select("key", F.col("text").cast("binary").alias("text"), "keep_id", "n")
    files = map_arrow(made, partial(_own, folder=fresh_dir(spark, "exact-index"), capacity=capacity), "path string, depth long, pages long, entries long, rows long, longest_chain long")
    return spark.createDataFrame(files.collect(), files.schema)  # one row for each owner; runs the job once


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64, owners: int | None = None, key: F.Column | None = None) -> DataFrame:
    """Group rows whose texts are the same bytes; the one with the largest id of each group stays.

    One row for each input row: id (as long), keep_id, group_size (rows of the group), kept, text_sha256 (lower-case hex).
    A null text is an empty text. Rows with a null id count in group_size; keep_id is null if no row of a group has an
    id, and kept is then true for all its rows, otherwise false for rows with a null id. Rows that repeat both the id
    and the text of the row that stays are all kept. An empty table gives an empty result; other columns of ``df`` are
    not read. ``key`` replaces the 64-bit key of column ``text`` (tests force collisions with it).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", (F.xxhash64("text") if key is None else key).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    files = build_index(df, id_col, text_col, capacity, owners, key)
    parts = max(1, shuffle_partitions(df.sparkSession))
    share = (files.agg(F.sum("rows")).first()[0] or 0) / (4 * parts)
    # The planner takes entries for as small as the list of files; they are as many as distinct texts, so no broadcast.
    entries = map_arrow(files.select("path").repartition(parts), _entries, "key long, text_sha256 string, keep_id long, group_size long")
    # A text that many rows have is laid out for as many tasks as there are partitions, and its rows are dealt among them.
    large = entries.filter(F.col("group_size") > share).select("key", "text_sha256", F.lit(parts).alias("split"))  # fewer than 4 * parts rows
    spread = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.coalesce("split", F.lit(1)))
    rows = rows.join(F.broadcast(large), ["key", "text_sha256"], "left").withColumn("deal", spread).drop("split")
    entries = entries.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("group_size") > share, parts).otherwise(1).cast("long") - 1)))
    return rows.join(entries.hint("merge"), ["key", "text_sha256", "deal"]).select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
