"""Retrieval and text: nearest documents, tokenizers, text generation behind an interface that works offline."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.ml.kernels import total
from gridloom.operators.windows import top_n_row_number


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _best(queries: pa.Table, documents: pa.Table, k: int) -> pa.Table:
    """The k best documents of a group for each query of a block, some thousand distances a query at a time."""
    if not queries.num_rows or not documents.num_rows:
        return pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
    vectors, w = (np.asarray(t.column("v").combine_chunks().flatten(), float).reshape(t.num_rows, -1) for t in (queries, documents))
    ids, d = queries.column("q").to_numpy(), documents.column("d").to_numpy()
    norms, some = (w * w).sum(axis=1)[None, :], []
    for start in range(0, len(ids), 256):
        v = vectors[start : start + 256]
        far = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ w.T + norms, 0.0)
        order = np.lexsort((np.broadcast_to(d, far.shape), far), axis=1)[:, :k]
        some.append((np.repeat(ids[start : start + 256], order.shape[1]), d[order].reshape(-1), np.take_along_axis(far, order, axis=1).reshape(-1)))
    return pa.table(dict(zip(("q", "d", "far"), map(np.concatenate, zip(*some, strict=True)), strict=True)))


def nearest(queries: DataFrame, documents: DataFrame, query_id: str, vector: str, document_id: str, k: int = 1, block: int = 4096) -> DataFrame:
    """For every query its k nearest documents, exactly: (query_id, document_id, distance, place); ids are integers.

    Queries are dealt to blocks and documents to groups of some ``block``, and every block meets every group in one
    task, in numpy. Only k rows for each query and group are shuffled on, and no vector passes the driver.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    docs = documents.select(F.col(document_id).cast("long").alias("d"), F.col(vector).cast("array<double>").alias("v"))
    blocks, groups = (max(1, -(-x.count() // block)) for x in (asked, docs))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b")).select("*", every(groups, "g"))
    right = docs.select("*", F.pmod(F.xxhash64("d"), F.lit(groups)).cast("int").alias("g")).select("*", every(blocks, "b"))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(lambda a, b: _best(a, b, k), "q long, d long, far double")
    top = top_n_row_number(found, ["q"], ["far", "d"], k, "place")
    return top.select(F.col("q").alias(query_id), F.col("d").alias(document_id), F.col("far").alias("distance"), "place")


def hash_tokenizer(text: Column, size: int = 30_000) -> Column:
    """Lower-case words as ids by a hash: a vocabulary that needs no file."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def file_tokenizer(text: Column, path: str) -> Column:
    """Ids by a tokenizers file that every worker can read."""

    def run(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path).encode_batch([t or "" for t in s], add_special_tokens=False)
        return pd.Series([e.ids for e in made])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(text)


class Provider(Protocol):
    """Anything that answers prompts: a service's client, or the stub below. It must be picklable."""

    def complete(self, prompts: Sequence[str]) -> list[str]: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class OfflineProvider:
    """Answers and vectors that depend on the text alone: for tests, and where there is no network."""

    def __init__(self, width: int = 8):
        self.width = width

    def complete(self, prompts):
        return [f"answer-{hashlib.sha256(p.encode()).hexdigest()[:8]}" for p in prompts]

    def embed(self, texts):
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.width]] for t in texts]


def complete(prompt: Column, provider: Provider) -> Column:
    """Answers, a batch of prompts in one call."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.complete([t or "" for t in s]))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(prompt)


def embed(text: Column, provider: Provider) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.embed([t or "" for t in s]))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(text)


def recommend(profile: Column, candidates: Column, provider: Provider) -> Column:
    """An answer to a prompt made of a user's profile and candidate titles."""
    return complete(F.concat(F.lit("User: "), profile, F.lit("\nChoose from: "), F.array_join(candidates, "; ")), provider)
