"""Encoding with the tokenizers and sentencepiece libraries, each text split at safe boundaries.

Where the file's own normaliser and pre-tokeniser are those of SAFE, ASCII white space is a safe boundary: pre-tokens
never hold white space, no normalisation joins characters across it, and no special token contains it. So the ids of a
text are those of its words, each encoded by the library once and remembered. A word without white space, however long,
goes whole; so does every text under another file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa

from gridloom.llm import textnum

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Words remembered in each of two generations, and bytes of the longest word remembered.
REMEMBERED, LONGEST = 500_000, 64
#: Words of letters joined into one text for the library, and bytes of texts given to it in one call.
JOINED, CALL_BYTES = 200, 1 << 18
Encode = Callable[[list[str]], Iterable[list[int]]]

#: Parts of a tokenizer file, fixed values: with these, and special tokens in ``<|`` and ``|>``, white space only parts words.
SAFE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Settings of its model, likewise.
SAFE_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: ASCII punctuation that may end a word: what ``split`` parts by itself, and all that a memo parts (no apostrophe, nothing of a special token).
_TAIL = b".,;:!?"
_TAILS = _TAIL + b'"#$%&()*+-/=@[\\]^_`{}~'
_mark = np.zeros(256, bool)
_mark[list(_TAIL)] = True
#: Second bytes of the two-byte letters that begin with C3: all but the signs for times and divided by.
_second = np.zeros(256, bool)
_second[0x80:0xC0] = True
_second[[0x97, 0xB7]] = False


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where marks are to be parted from the word before them, and the offsets of each text; null is empty.

    A text of Latin-1 characters without the opening of a special token is lowered (its ASCII letters; the vocabulary's
    normaliser does so anyway, and no combining mark can follow one), and a mark that ends a word of letters is parted
    from it, as the vocabulary's pre-tokeniser does. So fewer different words are met.
    """
    raw, offsets = textnum.buffer_of(column)
    if not len(raw):
        return raw, np.zeros(0, np.int64), offsets
    after = np.append(raw[1:], np.uint8(32))
    odd = np.flatnonzero((raw >= 0xC4) | ((raw == 60) & (after == 124)))
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, odd, side="right") - 1] = False
    inside = np.repeat(plain, np.diff(offsets))
    low = np.where(inside, textnum._lower[raw], raw)
    ends = textnum._space[after]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    at = np.flatnonzero(_mark[low] & ends & inside)
    at = at[at > 0]
    before = low[at - 1]
    letter = ((before >= 97) & (before <= 122)) | (_second[before] & (low[np.maximum(at - 2, 0)] == 0xC3))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    return low, at[letter & ~first[at]], offsets


def split(column: pa.Array) -> list[list[bytes]]:
    """For each text the words that may be encoded one by one; null is empty."""
    low, at, offsets = _parts(column)
    data, cuts = np.insert(low, at, 32).tobytes(), (offsets + np.searchsorted(at, offsets)).tolist()
    return [data[a:b].split() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _distinct(column: pa.Array) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """The different words of ``split``, the place among them of each word of all texts, and the offsets of each text's words."""
    low, at, offsets = _parts(column)
    held = ~textnum._space[low]
    starts = held.copy()
    starts[1:] &= ~held[:-1]
    starts[at] = True
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts &= held
    bounds = np.append(np.flatnonzero(starts[held]), np.count_nonzero(held))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(low[held])])
    coded = words.dictionary_encode()
    data, ends = _content(coded.dictionary)
    data, ends = data.tobytes(), ends.tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], coded.indices, np.searchsorted(np.flatnonzero(starts), offsets)


def _content(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of its own buffers, and the offsets of each value."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8), ends


def encode(column: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and the offsets of each text's; null is empty.

    A word is looked up once however often it occurs: no Python object is made for its other places.
    """
    if memo.ends is None:  # no boundary is known to be safe
        words = [(t or "").encode() for t in column.to_pylist()]
        places, cuts = pa.array(np.arange(len(words))), np.arange(len(words) + 1)
    else:
        words, places, cuts = _distinct(column)
    known = memo.know(words)
    data, ends = _content(pa.array([known[w] for w in words], pa.large_binary()).take(places))
    return data.view("<u4"), ends[cuts] // 4


class Memo:
    """A value of the packed ids of words that adds up when words are joined; the last ``REMEMBERED`` to twice as many words are looked up, not encoded.

    A word that isn't known is parted from the punctuation at its end, if the rest is letters: the two are separate
    pre-tokens. Words of letters are single pre-tokens, so many go to the library as one text, and their ids part at the
    tokens that end a word. Those of lower-case Latin letters need no normalising: ``plain`` is the same model without it.
    """

    def __init__(self, encode: Encode, plain: Encode | None, ends: np.ndarray | None, value: Callable[[bytes], object]):
        self.encode, self.plain, self.ends, self.value = encode, plain, ends, value
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.long: list[bytes] = []

    def know(self, words: list[bytes]) -> dict[bytes, object]:
        """A mapping that holds the value of every word of the list, until the next call."""
        for word in self.long:
            self.young.pop(word, None)
        new = {w for w in words if w not in self.young}
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young = self.young, {}
            new = set(words)
        back = {w for w in new if w in self.old}
        for word in back:
            self.young[word] = self.old[word]
        new -= back
        self.young.update(self._values(new))
        self.long = [w for w in new if len(w) > LONGEST]  # these are forgotten at the next call
        return self.young

    def _values(self, words: set[bytes]) -> dict[bytes, object]:
        if self.ends is None:
            return dict(zip(words, self._call(self.encode, [w.decode() for w in words]), strict=True))
        latin, letters, others, found, parts = set(), set(), set(), {}, []
        for word in words:
            if word.isalpha() and word.islower():  # of ASCII letters
                latin.add(word)
                continue
            text, core = word.decode(), word
            if not text.isalpha():
                core = word.rstrip(_TAILS)
                text = text[: len(core) - len(word)]
                if len(core) == len(word) or not text.isalpha() or not text.lower().isalpha():
                    others.add(word)
                    continue
                tail = word[len(core) :]
                others.add(tail)
                parts.append((word, core, tail))
            (latin if text.islower() and (text.isascii() or max(text) < "\u0250") else letters).add(core)
        for encode, kind in ((self.plain, latin), (self.encode, letters)):
            kind = list(kind)
            groups = [kind[i : i + JOINED] for i in range(0, len(kind), JOINED)]
            for group, packed in zip(groups, self._call(encode, [b" ".join(g).decode() for g in groups], raw=True), strict=True):
                stops = (4 * np.flatnonzero(self.ends[np.frombuffer(packed, "<u4")]) + 4).tolist()
                if len(stops) == len(group):
                    found.update(zip(group, (self.value(packed[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
                else:  # letters to us, but not to the vocabulary's pre-tokeniser
                    others.update(group)
        rest = list(others)
        found.update(zip(rest, self._call(self.encode, [w.decode() for w in rest]), strict=True))
        for word, core, tail in parts:
            found[word] = found[core] + found[tail]
        return found

    def _call(self, encode: Encode, texts: list[str], raw: bool = False) -> Iterable:
        call, size = [], 0
        for i, text in enumerate(texts):
            call.append(text)
            size += len(text)
            if size >= CALL_BYTES or i + 1 == len(texts):
                for ids in encode(call):
                    packed = np.asarray(ids, "<u4").tobytes()
                    yield packed if raw else self.value(packed)
                call, size = [], 0


def library(path: str) -> tuple[Encode, Encode | None, np.ndarray | None]:
    """The function that encodes texts with the library a vocabulary file is for, without special tokens added; one for lower-case Latin words; which ids end a word."""
    if not _is_json(path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), None, None
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    def encoder(tokenizer: Tokenizer) -> Encode:
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    full = Tokenizer.from_file(path)
    if not splits_at_space(path):
        return encoder(full), None, None
    vocabulary = full.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return encoder(full), encoder(plain), ends


_memos: dict[tuple, Memo] = {}


def memo(path: str, kind: str) -> Memo:
    """This process's memo of a vocabulary file; kind: 'length', or 'packed' for little-endian unsigned 32-bit ids."""
    if (path, kind) not in _memos:
        _memos[path, kind] = Memo(*library(path), (lambda ids: len(ids) // 4) if kind == "length" else (lambda ids: ids))
    return _memos[path, kind]


def _is_json(path: str) -> bool:
    with open(path, "rb") as source:
        return source.read(1) == b"{"


@cache
def _spec(path: str) -> dict:
    """What a tokenizer file says beside its vocabulary, and its greatest id."""
    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    model, added = spec["model"], spec.get("added_tokens") or []
    ids = [t["id"] for t in added]
    if isinstance(model.get("vocab"), dict):
        ids += model["vocab"].values()
    return {**{k: spec.get(k) for k in SAFE}, "added_tokens": added, "model": {k: model.get(k) for k in SAFE_MODEL}, "greatest": max(ids, default=1 << 31)}


@cache
def splits_at_space(path: str) -> bool:
    """Whether ASCII white space is a safe boundary of this vocabulary, by what its file says."""
    if not _is_json(path):
        return False
    spec = _spec(path)
    plain = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return plain and all(spec[k] == v for k, v in SAFE.items()) and spec["model"] == SAFE_MODEL


def greatest_id(path: str) -> int:
    """The greatest id of a vocabulary file."""
    if _is_json(path):
        return _spec(path)["greatest"]
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size() - 1
