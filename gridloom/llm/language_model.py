"""Scoring texts with a hashed maximum-entropy language model.

A word's probability is that of its class, given the words before, times its own within the class. The most frequent
words stand in classes of ``WIDTH`` by rank; all others are classed by a hash of their last two bytes, which in most
languages say much about the language and the kind of word. Two softmax layers, over classes and over the words of a
frequent class, add the weights of hashed features of the history: the word before (bigram), the two words before
(trigram), and the second word before alone (skip). Words outside the frequent classes have their smoothed share of
their class's count, so every word, known or not, has a probability. The tables' rows grow with the root of the training
tokens and the frequent classes with their logarithm.

Counts come from one distributed count of all training words. Training is distributed gradient descent: in each round
every task takes gradient steps over its own texts from the weights that it was given, and a row of weights becomes
the mean of what the tasks made of it, each weighed by how often it used the row; sums stream through owner tasks by
block. The rounds' documents are disjoint and together all of them. Scoring goes over each text once; counts of the
``LEXICON`` most frequent words travel with the tasks, those of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm._common import checkpoint, map_arrow, shuffle_partitions, slices, spread_by

U64 = np.uint64
#: Frequent classes at least, words in each, classes by word ending; rows of each feature's table at least (a power of two), words whose counts travel.
BINS, WIDTH, ENDINGS, ROWS, LEXICON = 16, 64, 32, 4096, 1 << 16
STEP, BATCH, TOKENS_A_TASK = 0.15, 8192, 1 << 22
END, START = textnum.mix(np.array([0xE4D], U64))[0], textnum.mix(np.array([0x57A27], U64))[0]
_factors = textnum.seeds(8, 9) | U64(1)


def table_rows(tokens: int) -> int:
    """Rows of each feature's table: the power of two next to the root of the training tokens."""
    return max(ROWS, 1 << round(np.log2(max(tokens, 1)) / 2))


def frequent_classes(tokens: int) -> int:
    """Two more for each doubling of the training tokens."""
    return BINS + max(0, int(2 * np.log2(max(tokens, 1) / TOKENS_A_TASK)))


class Lexicon(NamedTuple):
    tokens: int  # training tokens
    distinct: int
    words: np.ndarray  # hashes of the most frequent words, ascending
    counts: np.ndarray
    slots: np.ndarray  # place among the frequent classes' words, or -1
    shares: np.ndarray  # log10 of the counts of each class by ending, smoothed


class Model(NamedTuple):
    lexicon: Lexicon
    counts: DataFrame  # word, n of all training words
    weights: list[np.ndarray]


class Tokens(NamedTuple):
    hashes: np.ndarray
    ending: np.ndarray
    before: np.ndarray  # tokens before each text, one more than texts


def tokens(column: pa.Array) -> Tokens:
    """Words of all texts, each text followed by the end token."""
    raw, offsets = textnum.buffer_of(column)
    starts, ends, before = textnum.words(raw, offsets)
    n, texts = len(starts), len(offsets) - 1
    place = np.arange(n) + np.repeat(np.arange(texts), np.diff(before))
    hashes, ending = np.full(n + texts, END, U64), np.zeros(n + texts, np.int64)
    hashes[place] = textnum.span_hashes(raw, starts, ends)
    if n:
        low = textnum._lower[raw]
        last = low[ends - 1].astype(U64) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(U64) * U64(256)
        ending[place] = (textnum.mix(last + U64(1)) % U64(ENDINGS)).astype(np.int64)
    return Tokens(hashes, ending, before + np.arange(texts + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[Tokens] = []

    def flush() -> pa.RecordBatch:
        words, first, n = np.unique(np.concatenate([t.hashes for t in held]), return_index=True, return_counts=True)
        ending = np.concatenate([t.ending for t in held])[first]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ending.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    for batch in slices(batches, "text", textnum.BLOCK_BYTES):
        held.append(tokens(batch.column("text")))
        if sum(len(t.hashes) for t in held) > 1_500_000:
            yield flush()
    if held:
        yield flush()


def _lexicon(counts: DataFrame) -> Lexicon:
    sums = {r.ending: (r.total, r.kinds) for r in counts.groupBy("ending").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    # Few words are frequent: counts by power say from which on there are enough, so that no task sorts more than those.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    cut, enough = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):  # some 500 rows at most
        cut, enough = r.level, enough + r.words
        if enough >= LEXICON:
            break
    top = counts.filter(level >= cut).orderBy(F.desc("n"), "word").limit(LEXICON).toArrow()
    words, n, ending = top.column("word").to_numpy().view(U64), top.column("n").to_numpy(), top.column("ending").to_numpy()
    rank = np.argsort(words != END, kind="stable") if (words == END).any() else np.arange(len(words))  # the end token is always frequent
    total = sum(a for a, _ in sums.values())
    frequent = rank[: frequent_classes(total) * WIDTH]
    frequent = frequent[np.argsort(-n[frequent], kind="stable")]
    slots = np.full(len(words), -1)
    slots[frequent] = np.arange(len(frequent))
    shares = np.array([sum(sums.get(e, (0, 0))[:1]) + 0.5 * sums.get(e, (0, 0))[1] + 0.5 for e in range(ENDINGS)], float)
    np.subtract.at(shares, ending[frequent], n[frequent] + 0.5)
    order = np.argsort(words)
    return Lexicon(total, sum(b for _, b in sums.values()), words[order], n[order], slots[order], np.log10(shares))


def initial(lexicon: Lexicon) -> list[np.ndarray]:
    """Weights under which the model is the smoothed unigram model."""
    bins = frequent_classes(lexicon.tokens)
    # Tables over classes (bigram, trigram, skip) and over words of a class (bigram, skip); after them the two layers' biases.
    weights = [np.zeros((table_rows(lexicon.tokens), width), np.float32) for width in (*[bins + ENDINGS] * 3, WIDTH, WIDTH)]
    inner = np.full((bins, WIDTH), -30.0)
    has = lexicon.slots >= 0
    inner.reshape(-1)[lexicon.slots[has]] = np.log(lexicon.counts[has] + 0.5)
    outer = np.concatenate([np.logaddexp.reduce(inner, axis=1), lexicon.shares * np.log(10)])
    return [*weights, (outer - np.logaddexp.reduce(outer))[None].astype(np.float32), inner.astype(np.float32)]


class Examples(NamedTuple):
    """Tokens as the layers see them: class, place in a frequent class (-1: none), and each table's rows."""

    kind: np.ndarray
    inner: np.ndarray
    rows: list[np.ndarray]
    found: np.ndarray  # place in the lexicon, -1: none


def examples(t: Tokens, lexicon: Lexicon) -> Examples:
    n = len(t.hashes)
    found = np.full(n, -1)
    if len(lexicon.words):
        at = np.minimum(np.searchsorted(lexicon.words, t.hashes), len(lexicon.words) - 1)
        found = np.where(lexicon.words[at] == t.hashes, at, -1)
    slot = np.where(found >= 0, lexicon.slots[found], -1) if len(lexicon.words) else found
    kind = np.where(slot >= 0, slot // WIDTH, frequent_classes(lexicon.tokens) + t.ending)
    one, two = np.full(n, START, U64), np.full(n, START, U64)
    one[1:], two[2:] = t.hashes[:-1], t.hashes[:-2]
    firsts = t.before[:-1]
    one[firsts] = START
    two[firsts] = START
    seconds = firsts + 1
    two[seconds[seconds < t.before[1:]]] = START
    size = table_rows(lexicon.tokens)
    shift, row = U64(64 - int(np.log2(size))), np.uint16 if size <= 1 << 16 else np.uint32
    with np.errstate(over="ignore"):
        k = kind.astype(U64)
        keys = [one * _factors[0], one * _factors[1] + two * _factors[2], two * _factors[3], one * _factors[4] + k * _factors[5], two * _factors[6] + k * _factors[7]]
        rows = [((x ^ (x >> U64(29))) * _factors[0] >> shift).astype(row) for x in keys]
    return Examples(kind, np.where(slot >= 0, slot % WIDTH, -1), rows, found)


def _outer(weights: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    scores = weights[0].take(rows[0], axis=0)
    scores += weights[1].take(rows[1], axis=0)
    scores += weights[2].take(rows[2], axis=0)
    scores += weights[5]
    return scores


def _inner(weights: list[np.ndarray], rows: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
    scores = weights[3].take(rows[3], axis=0)
    scores += weights[4].take(rows[4], axis=0)
    scores += weights[6].take(kind, axis=0)
    return scores


def _chances(scores: np.ndarray) -> np.ndarray:
    """The softmax of each row; scores beyond 60 either way, which no data gives, are held there instead of shifting all rows."""
    np.clip(scores, -60, 60, out=scores)
    np.exp(scores, out=scores)
    scores /= (scores @ np.ones(scores.shape[1], np.float32))[:, None]
    return scores


def _segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int = 6) -> np.ndarray:
    """Sums of runs of rows. Most runs are short: their rows are added up one place at a time, only the rest of long ones run by run."""
    out = values.take(starts, axis=0)
    left = np.flatnonzero(ends - starts > 1)
    for k in range(1, steps):
        out[left] += values.take(starts[left] + k, axis=0)
        left = left[ends[left] - starts[left] > k + 1]
    if len(left):
        sizes = ends[left] - starts[left] - steps
        first = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(starts[left] + steps - first, sizes)
        out[left] += np.add.reduceat(values.take(rows, axis=0), first, axis=0)
    return out


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, used: np.ndarray) -> None:
    """One step on the rows used, each by its own rate (the root of its squared gradients so far)."""
    order = np.argsort(rows, kind="stable")  # a radix sort where rows are 16-bit
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    own, ends = ordered[starts], np.append(starts[1:], len(rows))
    summed = _segment_sums(gradient.take(order, axis=0), starts, ends)
    seen[own] += np.einsum("ij,ij->i", summed, summed) / summed.shape[1]
    table[own] -= STEP / np.sqrt(seen[own])[:, None] * summed
    used[own] += ends - starts


def _train(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    own = [w.copy() for w in weights]
    seen, used = [np.ones(len(w), np.float32) for w in own], [np.zeros(len(w), np.float32) for w in own]
    for batch in slices(batches, "text", textnum.BLOCK_BYTES):
        x = examples(tokens(batch.column("text")), lexicon)
        for i in range(0, len(x.kind), BATCH):
            part = slice(i, i + BATCH)
            rows, kind, inner = [r[part] for r in x.rows], x.kind[part], x.inner[part]
            gradient = _chances(_outer(own, rows))
            gradient[np.arange(len(kind)), kind] -= 1
            for j in range(3):
                _descend(own[j], seen[j], rows[j], gradient, used[j])
            whole = np.ones((1, len(kind)), np.float32) @ gradient
            _descend(own[5], seen[5], np.zeros(1, np.uint16), whole, used[5])
            used[5] += len(kind) - 1
            if len(has := np.flatnonzero(inner >= 0)):
                rows, kind = [r[has] for r in rows], kind[has]
                gradient = _chances(_inner(own, rows, kind))
                gradient[np.arange(len(has)), inner[has]] -= 1
                for j in (3, 4):
                    _descend(own[j], seen[j], rows[j], gradient, used[j])
                _descend(own[6], seen[6], kind.astype(np.uint16), gradient, used[6])
    for block, (table, at) in enumerate(_blocks(weights)):
        some = np.flatnonzero(used[table][at])
        if len(some):
            change = (own[table][at] - weights[table][at])[some].astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some.astype(np.int32).tobytes()]), pa.array([used[table][at][some].tobytes()]), pa.array([change.tobytes()])], ["block", "rows", "used", "change"])


def _blocks(weights: list[np.ndarray], size: int = 128) -> list[tuple[int, slice]]:
    return [(i, slice(a, a + size)) for i, w in enumerate(weights) for a in range(0, len(w), size)]


def _mean(batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Add up what tasks made of the blocks of one owner, row by row as it comes."""
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, rows, used, change in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "used", "change")), strict=True):
            summed, weight = totals.setdefault(block, (np.zeros(shapes[block]), np.zeros(shapes[block][0])))
            rows, used = np.frombuffer(rows, np.int32), np.frombuffer(used, np.float32)
            summed[rows] += np.frombuffer(change, np.float16).reshape(len(rows), -1).astype(float) * used[:, None]
            weight[rows] += used
    for block, (summed, weight) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(summed / np.maximum(weight, 1)[:, None]).astype(np.float32).tobytes()])], ["block", "change"])


def fit(train: DataFrame, text_col: str = "text", rounds: int = 2) -> Model:
    """Count all words of ``train`` and learn the weights; null texts are empty. The model grows with the root of the training tokens."""
    rows = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = checkpoint(map_arrow(rows, _count, "word long, ending int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")))
    lexicon = _lexicon(counts)
    weights = initial(lexicon)
    # Tasks have more tokens as tables have more rows, so that what all tasks send grows as the tokens do.
    own_tokens = TOKENS_A_TASK * (table_rows(lexicon.tokens) // ROWS)
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-lexicon.tokens // (own_tokens * rounds)))
    blocks = _blocks(weights)
    shapes = [weights[i][at].shape for i, at in blocks]
    owners = min(len(blocks), shuffle_partitions(train.sparkSession))
    for turn in range(rounds):
        own = rows.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).coalesce(tasks)
        made = map_arrow(own, partial(_train, lexicon=lexicon, weights=weights), "block int, rows binary, used binary, change binary")
        means = map_arrow(spread_by(made.withColumn("owner", F.col("block") % owners), "owner", owners).drop("owner"), partial(_mean, shapes=shapes), "block int, change binary")
        weights = [w.copy() for w in weights]
        for r in means.collect():  # the model's size, once
            table, at = blocks[r.block]
            weights[table][at] += np.frombuffer(r.change, np.float32).reshape(shapes[r.block])
    return Model(lexicon, counts.select("word", "n"), weights)


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[before])


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    floor = np.log10(lexicon.tokens + 0.5 * (lexicon.distinct + 1))
    logs = np.log10(lexicon.counts + 0.5)
    for batch in slices(batches, "text", textnum.BLOCK_BYTES):
        t = tokens(batch.column("text"))
        x = examples(t, lexicon)
        known = x.found >= 0
        own = np.zeros(len(known))
        own[known] = logs[x.found[known]]
        score = np.zeros(len(known))
        for i in range(0, len(known), BATCH):
            part = slice(i, i + BATCH)
            rows, kind, inner = [r[part] for r in x.rows], x.kind[part], x.inner[part]
            chance = _chances(_outer(weights, rows))[np.arange(len(kind)), kind].astype(float)
            if len(has := np.flatnonzero(inner >= 0)):
                chance[has] *= _chances(_inner(weights, [r[has] for r in rows], kind[has]))[np.arange(len(has)), inner[has]]
            score[part] = np.log10(np.maximum(chance, 1e-30))
        rest = x.inner < 0
        score[rest] += own[rest] - lexicon.shares[x.kind[rest] - frequent_classes(lexicon.tokens)]
        n = np.diff(t.before)
        spots = [batch.column(c).to_numpy() for c in ("spot", "spot2")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(textnum.mix(spots[0].view(U64)).view(np.int64)), *map(pa.array, spots), pa.array(np.zeros(len(n), np.int32)), batch.column("id"), pa.array(n.astype(np.int64)), pa.array(_sums(known, t.before).astype(np.int64)), pa.array(_sums(own - floor, t.before)), pa.array(_sums(score, t.before))],
            _COLUMNS,
        )
        rare = np.flatnonzero(~known)
        if len(rare):
            of = np.searchsorted(t.before, rare, side="right") - 1
            none = lambda kind: pa.nulls(len(rare), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.hashes[rare].view(np.int64)), *(pa.array(x[of]) for x in spots), pa.array(np.ones(len(rare), np.int32)), none(batch.column("id").type), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())],
                _COLUMNS,
            )


_COLUMNS = ["word", "spot", "spot2", "times", "id", "n_tokens", "known", "base", "score"]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_tokens (words and one end), n_known, train_tokens, base_score, score; the last two are log10 probabilities.

    A null text is an empty text: the end token alone. With nothing learned every token has probability 1 in the base
    model. Null ids and repeated rows are scored each on their own; an empty table gives an empty result.
    """
    # What is found of a row meets under 128 bits of its content, which a task that runs again can't change; rows that are
    # alike meet too, so sums are shared out among them.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(F.col(id_col), text).alias("spot"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("spot2"), F.col(id_col).alias("id"), text.alias("text"))
    parts = map_arrow(rows, partial(_score, lexicon=model.lexicon, weights=model.weights), f"word long, spot long, spot2 long, times int, id {dict(rows.dtypes)['id']}, n_tokens long, known long, base double, score double")
    joined = parts.join(model.counts, "word", "left")
    rare = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    summed = joined.groupBy("spot", "spot2").agg(
        F.count("n_tokens").alias("alike"), F.max("id").alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce("known", F.lit(0)) + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + rare).alias("base_score"), F.sum(F.coalesce("score", F.lit(0.0)) + rare).alias("score"),
    )
    each = summed.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    share = lambda name: F.col(name) / F.col("alike")
    return each.select(
        F.col("id").alias(id_col), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(model.lexicon.tokens).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score")
    )
