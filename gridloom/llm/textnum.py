"""Words and word hashes of many texts at once, in numpy.

A block of texts is one byte buffer. ASCII upper case is lowered, words are runs of bytes that are not ASCII white
space, and each word's 64-bit hash is a difference of a polynomial prefix sum (modulo 2**64, with an odd base and a
table of random byte values), mixed at the end. Costs a few nanoseconds a byte and makes no Python object a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once, so that the temporaries stay in cache; a longer text is handled alone and whole.
BLOCK_BYTES = 1 << 20
#: Bytes of a longer text that are hashed at once.
SPAN_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([salt], dtype=U64)))


_byte_value = seeds(256, 1)
_byte_lowered = _byte_value[_lower]
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, SPAN_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse, U64)]))
    return _powers[:n], _inverses[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("").cast(column.type))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words come before each text (one more than texts)."""
    solid = ~_space[raw]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by its content alone; spans are in order. Holds SPAN_BYTES at once, or one longer span."""
    value, out, i = _byte_lowered if lower else _byte_value, np.empty(len(starts), U64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN_BYTES, side="right")))
            part = raw[starts[i] : ends[j - 1]]
            powers, inverses = _power_tables(len(part) + 1)
            sums = np.empty(len(part) + 1, U64)
            sums[0] = 0
            np.cumsum(value[part] * powers[:-1], out=sums[1:])
            first, last = starts[i:j] - starts[i], ends[i:j] - starts[i]
            out[i:j] = mix((sums[last] - sums[first]) * inverses[first])
            i = j
    return out


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many words come before each text."""
    raw, offsets = buffer_of(column)
    starts, ends, before = words(raw, offsets)
    return span_hashes(raw, starts, ends, lower), before


def shingle_sets(hashes: np.ndarray, before: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of all its words if it has fewer."""
    factors = seeds(size, 2) | U64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        full = np.zeros(n, U64)
        for j in range(size):
            full += hashes[j : j + n] * factors[j]
        full = mix(full)
        found = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= size:
                found.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                found.append(mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + U64(b - a) * U64(_BASE)))
            else:
                found.append(np.zeros(0, U64))
    return found
