"""Byte-level BPE in linear time: longest matches, and backtracking where two neighbours are not compatible.

A piece's encoding is the one sequence of tokens in which every two neighbours are what BPE makes of their joined
bytes. So an encoder may walk from the left, take the longest token that starts at the place it stands at and is
compatible with the token before, and go back a token where none is: a place that was left once is never tried again,
which bounds the work by the number of bytes times a token's greatest length. Bytes are mapped to Latin-1 so that an
Aho-Corasick automaton of character strings finds the tokens. Whether two tokens may stand together is worked out from
the merges that made them, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import map_arrow, slices

#: Pieces remembered in each of two generations, bytes of the longest one remembered, and pairs of neighbours remembered.
REMEMBERED, LONGEST, PAIRS = 150_000, 64, 600_000
NEVER = 1 << 62
_GAP = "Ā"  # not a Latin-1 character: parts pieces in one run of the automaton


class Vocabulary:
    """A byte-level vocabulary by ranks; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.lengths = [0] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            if len(token) > 1 and (made := self._parts(token)):
                self.parts[rank] = made
                self.merged[made] = rank
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.forget()

    def forget(self) -> None:
        """Let go of what is remembered of the texts seen."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.fits.clear()
        self.spines.clear()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as source:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, source)})

    def _parts(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what merging by lower ranks alone leaves of it."""
        own, pieces = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            rank, at = min(((self.ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))), default=(own, 0))
            if rank >= own:
                return None  # no merges make it; it is matched as a whole piece only
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens as they are when they stand together, remembered."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at one end of this one while it is made, the whole first: (token, merge that makes it, merge that it ends in).

        Merges are numbered by rank, which is the order BPE makes them in; a byte is there from the start (-1).
        """
        key = (token, side)
        if key not in self.spines:
            steps, now, gone = [], token, NEVER
            while now in self.parts:
                steps.append((now, now, gone))
                now, gone = self.parts[now][side], now
            self.spines[key] = [*steps, (now, -1, gone)]
        return self.spines[key]

    def _compatible(self, left: int, right: int) -> bool:
        """Go back in time over the pairs of tokens that meet at the border: none of them may be a merge that comes before either is merged away.

        Of equal merges the one further left comes first: those within the left token before those over the border,
        and these before those within the right token.
        """
        ours, theirs = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_made, a_gone), (b, b_made, b_gone) = ours[i], theirs[j]
            merge = self.merged.get((a, b), NEVER)
            if merge < a_gone and merge <= b_gone and merge != NEVER:
                return False
            if a_made > b_made:
                i += 1
            elif b_made >= 0:
                j += 1
            else:
                return True

    def _prefix(self, token: int) -> int | None:
        """The next shorter token that begins this one."""
        if token not in self.shorter:
            text = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), None)
        return self.shorter[token]

    def _walk(self, piece: str) -> list[int]:
        lengths, known, fits = self.lengths, self.fits.get, self.compatible
        longest: list[int | None] = [None] * len(piece)
        reach = [0] * len(piece)
        for end, token in self.automaton.iter(piece):
            n = lengths[token]
            at = end - n + 1
            if n > reach[at]:
                reach[at], longest[at] = n, token
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if dead[end]:
                fine = False
            elif not out:
                fine = True
            else:
                fine = known(out[-1] << 32 | token)
                if fine is None:
                    fine = fits(out[-1], token)
            if fine:
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            else:
                token = self._prefix(token)
                while token is None:
                    dead[at] = 1
                    token = out.pop()
                    at -= lengths[token]
                    token = self._prefix(token)

    def _encode_new(self, pieces: list[str]) -> None:
        """Encode pieces by greedy longest matches of one run; those with neighbours that don't fit are walked."""
        pack, ranks, young = np.array, self.ranks, self.young
        latin = [p.encode().decode("latin-1") for p in pieces]
        found: list[list[int]] = []
        pending = [i for i, x in enumerate(latin) if x.encode("latin-1") not in ranks]
        text = _GAP.join(latin[i] for i in pending)
        ends, at = [], -1
        for i in pending:
            at += len(latin[i]) + 1
            ends.append(at)
        k, now, fine, known, fits = 0, [], True, self.fits.get, self.compatible
        for end, token in self.automaton.iter_long(text) if pending else ():
            while end >= ends[k]:
                found.append(now if fine else None)
                k, now, fine = k + 1, [], True
            if fine and now:
                fine = known(now[-1] << 32 | token)
                if fine is None:
                    fine = fits(now[-1], token)
            now.append(token)
        if pending:
            found.append(now if fine else None)
        for i, tokens in zip(pending, found, strict=True):
            young[pieces[i]] = pack(tokens or self._walk(latin[i]), "<u4").tobytes()
        for i in set(range(len(latin))).difference(pending):
            young[pieces[i]] = pack([ranks[latin[i].encode("latin-1")]], "<u4").tobytes()

    def know(self, pieces: list[str]) -> dict[str, bytes]:
        """A mapping that holds the packed ids of every piece of the list, until the next call."""
        for piece in self.long:
            del self.young[piece]
        new = set(pieces)
        new.difference_update(self.young)
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young = self.young, {}
            new = set(pieces)
        back = new & self.old.keys()
        for piece in back:
            self.young[piece] = self.old[piece]
        new -= back
        self._encode_new(list(new))
        self.long = [p for p in new if len(p) > LONGEST]  # these are forgotten at the next call
        return self.young

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def _forget(path: str) -> None:
    if path in _vocabularies:
        _vocabularies[path].forget()


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    vocab, find = vocabulary(path), regex.compile(pattern).findall
    for batch in slices(batches, "text", 1 << 20):
        pieces = [find(t or "") for t in batch.column("text").to_pylist()]
        known = vocab.know([p for x in pieces for p in x])
        ids = [b"".join(map(known.__getitem__, x)) for x in pieces]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in _encode(batches, path, pattern):
        ids = batch.column("ids").to_pylist()
        decoded = (vocab.decode(np.frombuffer(x, "<u4")) for x in ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in slices(batches, "ids", 1 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if x is None else vocab.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()], pa.binary())], ["id", "bytes"])


def _rows(df: DataFrame, id_col: str, column: str, name: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.col(column).alias(name))
    return rows, f"id {dict(rows.dtypes)['id']}"


def encode(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of each whole text as little-endian unsigned 32-bit integers; each match of ``pattern`` is encoded separately.

    A null text is an empty text: no ids. Null ids and repeated rows stay; an empty table gives an empty result; other
    columns are not read.
    """
    rows, kind = _rows(df, id_col, text_col, "text")
    return map_arrow(rows, partial(_encode, path=vocabulary_path, pattern=pattern), f"{kind}, ids binary", partial(_forget, vocabulary_path)).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of packed ids; null ids give null."""
    rows, kind = _rows(df, id_col, ids_col, "ids")
    return map_arrow(rows, partial(_decode, path=vocabulary_path), f"{kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts; as ``encode`` for odd rows."""
    rows, kind = _rows(df, id_col, text_col, "text")
    return map_arrow(rows, partial(_digest, path=vocabulary_path, pattern=pattern), f"{kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_forget, vocabulary_path)).withColumnRenamed("id", id_col)
