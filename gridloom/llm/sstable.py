"""Token ids in sorted-string-table shards.

A shard is one file with documents in ascending order of their identifier:

    magic
    data blocks    entries of ascending keys; every 16th key is whole (a restart), others share a prefix with the last
    index block    one entry a data block: first key, offset, bytes, documents, tokens
    Bloom filter   ten bits a key, seven probes
    footer         offsets and sizes of index and filter, documents, tokens, CRC-32 of index and filter, magic

A key is 0x00 for a null identifier, else 0x01 and eight big-endian bytes that sort as the number does. A value is the
ids as little-endian 16-bit or 32-bit integers, by the shard. Blocks are compressed with zstd. A lookup asks the
filter, finds the block by binary search in the index, and the entry by binary search among the block's restarts.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import wordpieces
from gridloom.llm._common import filesystem, fresh_dir, map_arrow, shuffle_partitions, slices, write_file

MAGIC = b"GLSSTBL1"
RESTART, BLOCK = 16, 1 << 18
INDEX = struct.Struct("<B9sQIII")  # key length, first key, offset, bytes, documents, tokens' low part
FOOTER = struct.Struct("<QIQIQQBI8s")  # index offset and bytes, filter offset and bytes, documents, tokens, bytes an id, CRC-32, magic


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + (identifier + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> Iterator[int]:
    one, two = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return ((one + i * two) % bits for i in range(7))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class Writer:
    """The parts of a shard file, from (identifier, ids) in ascending order; holds one block and the index."""

    def __init__(self, width: int):
        self.width, self.at, self.index, self.keys = width, 0, [], []
        self.documents = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.last, self.first, self.n, self.n_tokens = bytearray(), [], b"", None, 0, 0

    def add(self, identifier: int | None, ids: np.ndarray) -> Iterator[bytes]:
        key = key_of(identifier)
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += bytes((shared, len(key) - shared)) + key[shared:] + _varint(len(value)) + value
        self.first = key if self.first is None else self.first
        self.last, self.n, self.n_tokens = key, self.n + 1, self.n_tokens + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            yield self._flush()

    def _flush(self) -> bytes:
        tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        data = self.pack(bytes(self.block) + tail)
        if not self.at:
            data, offset = MAGIC + data, len(MAGIC)
        else:
            offset = self.at
        self.index.append((self.first, offset, len(data) - (len(MAGIC) if not self.at else 0), self.n, self.n_tokens))
        self.at += len(data)
        self.documents, self.tokens = self.documents + self.n, self.tokens + self.n_tokens
        self._begin()
        return data

    def finish(self) -> Iterator[bytes]:
        if self.n:
            yield self._flush()
        index = b"".join(INDEX.pack(len(key), key, at, size, n, tokens) for key, at, size, n, tokens in self.index)
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        yield index
        yield bytes(bloom)
        crc = zlib.crc32(bytes(bloom), zlib.crc32(index))
        yield FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, crc, MAGIC)


class Table:
    """A shard file, opened: its footer, index and filter are in memory, blocks are read when asked for."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        self.source = system.open_input_file(place)
        size = self.source.size()
        self.index_at, n_index, bloom_at, n_bloom, self.documents, self.tokens, self.width, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, self.bloom = self._read(self.index_at, n_index), self._read(bloom_at, n_bloom)
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.blocks = [(key[:n], at, length) for n, key, at, length, _, _ in INDEX.iter_unpack(index)]
        self.firsts = [b[0] for b in self.blocks]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        data = zstandard.ZstdDecompressor().decompress(self._read(self.blocks[i][1], self.blocks[i][2]))
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 - 4 * n
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    def _entries(self, data: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, rest = data[at], data[at + 1]
            key = key[:shared] + data[at + 2 : at + 2 + rest]
            n, at = _read_varint(data, at + 2 + rest)
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            data, _, end = self._block(i)
            for key, ids in self._entries(data, 0, end):
                yield id_of(key), ids

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every document under an identifier, none if there is none."""
        key, found = key_of(identifier), []
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return found
        for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            data, restarts, end = self._block(i)
            whole = [data[r + 2 : r + 2 + data[r + 1]] for r in restarts]
            start = restarts[max(0, bisect.bisect_left(whole, key) - 1)]
            for k, ids in self._entries(data, start, end):
                if k > key:
                    break
                if k == key:
                    found.append(ids.copy())
        return found


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    memo, shard, writer = wordpieces.memo(path, "packed"), None, Writer(width)

    def parts() -> Iterator[bytes]:
        nonlocal shard
        for batch in slices(batches, "text", 4 << 20):
            shard = batch.column("shard")[0].as_py()
            ids, offsets = wordpieces.encode(batch.column("text"), memo)
            for identifier, a, b in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield from writer.add(identifier, np.append(ids[a:b], np.uint32(end_id)))
        yield from writer.finish()

    made = write_file(folder, "shard", parts())
    if writer.documents:
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [made], "documents": [writer.documents], "tokens": [writer.tokens]}, schema=_MANIFEST)


def write_shards(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, id_bytes: int | None = None, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode all texts, append ``end_id`` to each, and write shards in ascending order of the identifier.

    Returns the manifest, one row a shard in order: shard, path, documents, tokens, start (tokens of all shards
    before). Null texts are empty; rows with a null identifier come first; rows that repeat an identifier stay, in the
    order of their texts' hashes. ``id_bytes`` is 2 or 4, by the vocabulary's greatest id unless given; an id that doesn't
    fit is an error. An empty table gives no shard. Shards lie in ``folder``; if none is given, in one below the shared
    folder that goes when the application ends.
    """
    spark = df.sparkSession
    id_bytes = id_bytes or (2 if max(end_id, wordpieces.greatest_id(tokenizer_path)) < 1 << 16 else 4)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("shard"))
    files = map_arrow(dealt, partial(_write, folder=folder or fresh_dir(spark, "sstable"), path=tokenizer_path, end_id=end_id, width=id_bytes), "shard int, path string, documents long, tokens long")
    made, start = [], 0
    for row in sorted(files.collect()):  # one row a shard
        made.append((*row, start))
        start += row.tokens
    return spark.createDataFrame(made, "shard int, path string, documents long, tokens long, start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows = []
            for identifier, ids in Table(path):
                rows.append((identifier, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _summary(rows)
                    rows = []
            if rows:
                yield _summary(rows)


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(1, shuffle_partitions(manifest.sparkSession))
    out = map_arrow(manifest.select("path", "start").repartition(n), _read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
