"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits; one binary classifier for each bit tells the languages with +1 from
those with -1 by hashed character n-grams. With few languages the code is exhaustive (all ways to halve them), else
random with codewords kept far apart. Decoding is loss-weighted: the distance to a language's codeword is the sum of
each bit's loss, weighted by how often that bit was right for that language on calibration rows; the nearest codeword
wins. A prediction is flagged as ambiguous if the runner-up is nearly as near, or if more bits are wrong than the code
corrects.

The classifiers are log-ratios of n-gram frequencies, so fitting is one distributed count over all training rows, and
the weights of a bucket of n-grams are worked out where its counts are. The driver holds names and codewords of the
languages and buckets x bits weights; bits grow with the logarithm of the languages. Calibration uses weights without
the rows that it looks at (a tenth, chosen by a hash of the text); the final weights have the counts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpoint, map_arrow, parts_for, slices

ORDERS, BUCKETS, UNKNOWN = (1, 2, 3, 4), 1 << 15, "und"
#: Languages whose counts a task holds at once.
HELD = 64
U32 = np.uint32

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed n-grams of all texts, in order, and how many come before each text (one more than texts).

    Characters that aren't letters count as one kind of space; n-grams of space alone are left out.
    """
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([0, *map(len, lowered)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), U32)
    letter = _letters()[points]
    points = np.where(letter, points, U32(32))
    n = len(points)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    hashes, some = np.zeros(n, U32), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for order in range(1, max(ORDERS) + 1):
            m = max(0, n - order + 1)
            hashes = (hashes[:m] ^ (hashes[:m] >> U32(15))) * U32(0x85EBCA77) + points[order - 1 :] * U32(0x9E3779B1) + U32(order)
            some = some[:m] | letter[order - 1 :]
            if order in ORDERS:
                fit = np.flatnonzero(some & (text[:m] == text[order - 1 :]))
                mixed = hashes[fit]
                mixed = (mixed ^ (mixed >> U32(16))) * U32(0xC2B2AE3D)
                yield (mixed >> U32(17)).astype(np.int32), np.searchsorted(fit, ends)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # bits: margins are divided by it
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One codeword a language: exhaustive up to six languages, else the best of random codes by least distance."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        columns = np.arange(1, 1 << (n - 1))
        return np.vstack([np.ones(len(columns)), *(1 - 2 * (columns >> i & 1) for i in range(n - 1))]).astype(np.int8)
    draw, bits = np.random.default_rng(seed), int(np.ceil(8 * np.log2(n)))
    best, apart = None, -1.0
    for _ in range(64 if n <= 1000 else 1):
        code = draw.choice([-1, 1], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(((code.shape[1] - code[i : i + 1000] @ code.T) / 2 + 1e9 * (np.arange(n) == np.arange(i, min(n, i + 1000))[:, None])).min() for i in range(0, n, 1000))
        if least > apart:
            best, apart = code, least
    return best.astype(np.int8)


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """N-grams by language and bucket: all, and those of rows that aren't looked at for calibration (fold 0)."""
    place = {x: i for i, x in enumerate(languages)}
    total: dict[int, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for language, counts in total.items():
            bucket = np.flatnonzero(counts.sum(axis=0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), language, np.int32)), pa.array(bucket), pa.array(counts[:, bucket].sum(axis=0)), pa.array(counts[1, bucket])], ["language", "bucket", "n", "first"])
        total.clear()

    for batch in slices(batches, "text", 1 << 19):
        folds = (batch.column("fold").to_numpy() != 0).astype(np.int64)
        rows = sorted(zip((place[x] for x in batch.column("lang").to_pylist()), folds.tolist(), batch.column("text").to_pylist(), strict=True), key=lambda r: r[:2])
        kinds = np.array([2 * language + fold for language, fold, _ in rows])
        for hashes, before in grams([text for _, _, text in rows]):
            for kind in np.unique(kinds).tolist():
                a, b = np.searchsorted(kinds, kind), np.searchsorted(kinds, kind, side="right")
                counts = total.setdefault(kind // 2, np.zeros((2, BUCKETS), np.int64))
                counts[kind % 2] += np.bincount(hashes[before[a] : before[b]], minlength=BUCKETS)
        if len(total) > HELD:
            yield from flush()
    yield from flush()


def _weigh(batches: Iterator[pa.RecordBatch], code: np.ndarray, sums: np.ndarray, smoothing: float) -> Iterator[pa.RecordBatch]:
    """Weights of each bucket, from its counts by language: of all rows, and without those of fold 0."""
    most = max(1, (1 << 21) // max(code.shape))
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            rows, made = batch.slice(start, most), []
            language = rows.column("languages")
            at = np.repeat(np.arange(len(rows)), np.diff(language.offsets.to_numpy()))
            for name, total in zip(("n", "first"), sums, strict=True):
                share = np.full((len(rows), len(code)), smoothing)
                share[at, language.flatten().to_numpy()] += rows.column(name).flatten().to_numpy()
                made.append([w.tobytes() for w in _log_ratio(share / total, code).astype("<f4")])
            yield pa.RecordBatch.from_arrays([rows.column("bucket"), *(pa.array(m, pa.binary()) for m in made)], ["bucket", "n", "first"])


def _log_ratio(shares: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each bit the logarithm of the mean share among languages with +1 over that among those with -1."""
    one = (code > 0).astype(float)
    return (np.log(shares @ one / one.sum(axis=0)) - np.log(shares @ (1 - one) / (1 - one).sum(axis=0))).clip(-5, 5)


def _margins(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of each text's n-grams, texts x bits, and how many n-grams there are."""
    sums, n = np.zeros((len(texts), weights.shape[1]), np.float64), np.zeros(len(texts), np.int64)
    for hashes, before in grams(texts):
        counts = np.diff(before)
        full = np.flatnonzero(counts)
        if len(full) == 1:  # one text, perhaps a long one
            sums[full[0]] += np.bincount(hashes, minlength=BUCKETS) @ weights.astype(float)
        elif len(full):
            sums[full] += np.add.reduceat(weights[hashes], before[full], axis=0)
        n += counts
    return sums / np.maximum(n, 1)[:, None], n


def _block(bits: int) -> int:
    """Bytes of text for which the gathered weights stay within some 16 MB."""
    return max(1 << 15, (2 << 20) // max(8, bits))


def _calibrate(batches: Iterator[pa.RecordBatch], languages: list[str], code: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(languages)}
    for batch in slices(batches, "text", _block(code.shape[1])):
        kinds = np.array([place[x] for x in batch.column("lang").to_pylist()])
        margins, n = _margins(batch.column("text").to_pylist(), weights)
        right = margins * code[kinds] > 0
        for i in np.unique(kinds[n > 0]):
            own = (kinds == i) & (n > 0)
            bits = np.arange(code.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bits), i), pa.int32()), pa.array(bits), pa.array(np.full(len(bits), own.sum()), pa.int64()), pa.array(right[own].sum(axis=0), pa.int64()), pa.array(np.abs(margins[own]).sum(axis=0))],
                ["language", "bit", "rows", "right", "size"],
            )


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn all languages from all rows with text and language; others are ignored. No such row: a model without languages.

    A language with no n-gram in its texts is known by smoothing alone. Calibration leaves out languages all of whose
    texts are in its own tenth, as it can't tell how well these are recognised.
    """
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # the names, once
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(code.shape))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(10)))
    counted = map_arrow(rows.select("text", "lang", "fold"), partial(_count, languages=languages), "language int, bucket int, n long, first long")
    counted = checkpoint(counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"), F.sum("first").alias("first")), parts_for(train.sparkSession, len(languages) * BUCKETS))  # at most languages x buckets rows
    sums = np.full((2, len(languages)), smoothing * BUCKETS)
    for r in counted.groupBy("language").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).collect():  # a row a language
        sums[:, r.language] += r.n, r.first
    weights = np.tile(np.stack([_log_ratio(smoothing / s, code) for s in sums])[:, None].astype(np.float32), (1, BUCKETS, 1))
    listed = counted.groupBy("bucket").agg(*(F.collect_list(c).alias(a) for c, a in (("language", "languages"), ("n", "n"), ("first", "first"))))  # a list holds a count a language
    found = map_arrow(listed, partial(_weigh, code=code, sums=sums, smoothing=smoothing), "bucket int, n binary, first binary").toArrow()  # a row a bucket
    for i, name in enumerate(("n", "first")):
        weights[i, found.column("bucket").to_numpy()] = np.frombuffer(b"".join(found.column(name).to_pylist()), "<f4").reshape(found.num_rows, -1)
    known = [x for x, n in zip(languages, sums[1], strict=True) if n > smoothing * BUCKETS]
    looked_at = rows.filter("fold = 0").join(F.broadcast(train.sparkSession.createDataFrame([(x,) for x in known], "lang string")), "lang", "left_semi")  # the names again
    checked = map_arrow(looked_at.select("text", "lang"), partial(_calibrate, languages=languages, code=code, weights=weights[1]), "language int, bit int, rows long, right long, size double")
    found = checked.groupBy("language", "bit").agg(F.sum("rows").alias("rows"), F.sum("right").alias("right"), F.sum("size").alias("size")).collect()  # languages x bits rows
    trust, size, seen = np.ones(code.shape), np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for r in found:
        trust[r.language, r.bit] = (r.right + 1) / (r.rows + 2)
        size[r.bit] += r["size"]
        seen[r.bit] += r.rows
    scale = np.where(seen > 0, size / np.maximum(seen, 1), 1.0)
    return Model(languages, code, weights[0], np.maximum(scale, 1e-6), trust / trust.sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def _least(code: bytes, n: int) -> int:
    words = np.frombuffer(code, np.int8).reshape(n, -1).astype(np.float32)
    return min(int(((words.shape[1] - words[i] @ np.delete(words, i, axis=0).T) / 2).min()) for i in range(n))


def apart(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    return _least(code.astype(np.int8).tobytes(), len(code))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score, and whether the text is ambiguous, from margins (texts x bits)."""
    scaled = (margins / model.scale).clip(-3, 3)
    one = model.code > 0
    distance = np.exp(-scaled) @ (model.trust * one).T + np.exp(scaled) @ (model.trust * ~one).T  # the loss of bit c is exp(-c * margin)
    order = np.argsort(distance, axis=1, kind="stable")
    best = order[:, 0]
    chance = np.exp(-4 * (distance - distance.min(axis=1, keepdims=True)))
    score = 1 / chance.sum(axis=1)
    rows = np.arange(len(margins))
    wrong = (np.sign(scaled) * model.code[best] < 0).sum(axis=1)
    ambiguous = (distance[rows, order[:, 1]] - distance[rows, best] < 0.1) | (wrong > (apart(model.code) - 1) // 2)
    return best, score, ambiguous


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    bits = model.code.shape[1]
    for batch in slices(batches, "text", _block(bits)):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        margins, n = _margins(texts, model.weights) if model.languages else (np.zeros((len(texts), 0)), np.zeros(len(texts), int))
        able = np.flatnonzero(n > 0)
        if len(able) and bits:
            best, scores[able], unsure[able] = decode(margins[able], model)
            for i, k in zip(able.tolist(), best.tolist(), strict=True):
                names[i] = model.languages[k]
        elif len(able) and model.languages:  # one language: nothing to tell apart
            scores[able], unsure[able] = 1.0, False
            for i in able.tolist():
                names[i] = model.languages[0]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names), pa.array(scores), pa.array(unsure)], ["row", "lang_pred", "score", "ambiguous"])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row: a learned language, or ``und`` with score 0 if the text is null or has no letter.

    Only the text is an input. Null ids and repeated rows are predicted each on their own; with no language learned
    every row is ``und``; an empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    out = map_arrow(rows, partial(_predict, model=model), f"row {dict(rows.dtypes)['row']}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("row", id_col)
