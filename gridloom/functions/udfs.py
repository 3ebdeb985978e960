"""Functions that the JVM has no expression for: Arrow-batched, never a row at a time across the boundary."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import itertools
import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _floats(*series: pd.Series) -> list[np.ndarray]:
    return [np.asarray(s, dtype=float) for s in series]


def _numeric(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A pandas function of double columns; null in any gives null."""

    def run(*s: pd.Series) -> pd.Series:
        columns = _floats(*s)
        with np.errstate(all="ignore"):
            return pd.Series(np.where(np.any([np.isnan(c) for c in columns], axis=0), np.nan, f(*columns)))

    def build(*columns: Column) -> Column:
        arity = len(columns)
        if arity == 2:
            made = F.pandas_udf(_two(run), "double")
        else:
            made = F.pandas_udf(_three(run), "double")
        absent = F.lit(False)
        for c in columns:
            absent = absent | c.isNull()
        return F.when(~absent, made(*(c.cast("double") for c in columns)))

    return build


def _two(run):
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return call


def _three(run):
    def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return call


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    flip = inside > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            total = total * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = front * total
    value = np.where(flip, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def incomplete_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    term, total = 1 / a, 1 / a
    for n in range(1, 1000):
        term = term * safe / (a + n)
        total = total + term
        if np.all(np.abs(term) < np.abs(total) * 1e-16):
            break
    low = front * total
    b = safe + 1 - a
    c, d = np.full_like(safe, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for n in range(1, 1000):
        step = -n * (n - a)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + step / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 0.0, np.where(safe < a + 1, low, 1 - front * h))


def _inverse_beta(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(100):
        middle = (low + high) / 2
        below = incomplete_beta(a, b, middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


normal_cdf = _numeric(lambda mean, sd, x: 0.5 * (1 + _erf((x - mean) / (sd * math.sqrt(2)))))
beta_cdf = _numeric(incomplete_beta)
inverse_beta_cdf = _numeric(_inverse_beta)
binomial_cdf = _numeric(lambda n, p, k: np.where(k < 0, 0.0, np.where(k >= n, 1.0, incomplete_beta(np.maximum(n - np.floor(k), 1e-9), np.floor(k) + 1, 1 - p))))
chi_squared_cdf = _numeric(lambda df, x: incomplete_gamma(df / 2, x / 2))
gamma_cdf = _numeric(lambda shape, scale, x: incomplete_gamma(shape, x / scale))
f_cdf = _numeric(lambda d1, d2, x: np.where(x <= 0, 0.0, incomplete_beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))))
poisson_cdf = _numeric(lambda rate, k: np.where(k < 0, 0.0, 1 - incomplete_gamma(np.floor(k) + 1, rate)))


def _bytes(f: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda column: F.pandas_udf(run, "binary")(column.cast("binary"))


def _xxhash64(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64(data, seed=0).digest()


xxhash64 = _bytes(_xxhash64)


def hmac(name: str) -> Callable[[Column, Column], Column]:
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else _hmac.new(bytes(k), bytes(d), name).digest() for d, k in zip(data, key, strict=True)])

    run.__annotations__ = {"data": pd.Series, "key": pd.Series, "return": pd.Series}
    return lambda data, key: F.pandas_udf(run, "binary")(data.cast("binary"), key.cast("binary"))


def ieee754(bits: int) -> Callable[[Column], Column]:
    form = ">d" if bits == 64 else ">f"

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(form, x) for x in np.asarray(s, float)])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda column: F.when(column.isNotNull(), F.pandas_udf(run, "binary")(column.cast("double")))


#: Fixed value: combinations of one array at most.
MOST_COMBINATIONS = 100_000


def combinations(array: Column, n: int) -> Column:
    """All combinations of n elements (at most 5), in the order of their places; more than MOST_COMBINATIONS are an error."""
    if not 0 <= n <= 5:
        raise ValueError("combinations takes n from 0 to 5")

    def of(a):
        if a is None:
            return None
        if math.comb(len(a), n) > MOST_COMBINATIONS:
            raise ValueError(f"more than {MOST_COMBINATIONS} combinations")
        return [list(c) for c in itertools.combinations(list(a), n)]

    def run(s: pd.Series) -> pd.Series:
        return s.map(of)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.ArrayType(T.LongType())))(array.cast("array<bigint>"))


# SpookyHash V2, from its public-domain specification ------------------------------------------------------------------
_M = (1 << 64) - 1
_CONST = 0xDEADBEEFDEADBEEF
#: Rotations of the short mix and end, the long mix and the long end.
_SHORT_MIX, _SHORT_END = (50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36), (15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)
_LONG_MIX, _LONG_END = (11, 32, 43, 31, 17, 28, 39, 57, 55, 54, 22, 46), (44, 15, 34, 21, 38, 33, 10, 13, 38, 53, 42, 54)


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _M


def _short(data: bytes) -> int:
    h = [0, 0, _CONST, _CONST]

    def blend() -> None:
        for i, n in enumerate(_SHORT_MIX):
            x, y, z = (2 + i) % 4, (3 + i) % 4, i % 4
            h[x] = _turn(h[x], n) + h[y] & _M
            h[z] ^= h[x]

    size, at = len(data), 0
    if size > 15:
        while size - at >= 32:
            a, b, c, d = struct.unpack_from("<4Q", data, at)
            h[2], h[3] = h[2] + a & _M, h[3] + b & _M
            blend()
            h[0], h[1] = h[0] + c & _M, h[1] + d & _M
            at += 32
        if size - at >= 16:
            a, b = struct.unpack_from("<2Q", data, at)
            h[2], h[3] = h[2] + a & _M, h[3] + b & _M
            blend()
            at += 16
    rest = data[at:]
    h[3] = h[3] + (size << 56) & _M
    if rest:
        h[2] = h[2] + int.from_bytes(rest[:8], "little") & _M
        h[3] = h[3] + int.from_bytes(rest[8:], "little") & _M
    else:
        h[2], h[3] = h[2] + _CONST & _M, h[3] + _CONST & _M
    for i, n in enumerate(_SHORT_END):
        x, y = (3 + i) % 4, (2 + i) % 4
        h[x] ^= h[y]
        h[y] = _turn(h[y], n)
        h[x] = h[x] + h[y] & _M
    return h[0]


def _long(data: bytes) -> int:
    h = [0, 0, _CONST] * 4
    whole = len(data) // 96 * 96
    for at in range(0, whole, 96):
        for i, (word, n) in enumerate(zip(struct.unpack_from("<12Q", data, at), _LONG_MIX, strict=True)):
            h[i] = h[i] + word & _M
            h[(i + 2) % 12] ^= h[(i + 10) % 12]
            h[(i + 11) % 12] ^= h[i]
            h[i] = _turn(h[i], n)
            h[(i + 11) % 12] = h[(i + 11) % 12] + h[(i + 1) % 12] & _M
    rest = data[whole:]
    block = rest + bytes(95 - len(rest)) + bytes([len(rest)])
    h = [x + w & _M for x, w in zip(h, struct.unpack("<12Q", block), strict=True)]
    for _ in range(3):
        for i, n in enumerate(_LONG_END):
            h[(i + 11) % 12] = h[(i + 11) % 12] + h[(i + 1) % 12] & _M
            h[(i + 2) % 12] ^= h[(i + 11) % 12]
            h[(i + 1) % 12] = _turn(h[(i + 1) % 12], n)
    return h[0]


def spooky_hash(data: bytes) -> int:
    return _short(data) if len(data) < 192 else _long(data)


def spooky(bits: int) -> Callable[[Column], Column]:
    return _bytes(lambda data: (spooky_hash(data) & ((1 << bits) - 1)).to_bytes(bits // 8, "big"))
