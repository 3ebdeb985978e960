"""Operators on texts against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, exact_dedup, langid, language_model, licenses, mixing, near_dedup, queries, sstable, token_counts, wordpieces

ODD = "doc_id long, text string, lang string, source string, id string, key int, row string, node int"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en", "a", "x", 1, "r", 1), (2, "", "en", None, "x", 1, "r", 1), (3, "the cat sat on the mat today again", "en", "a", None, None, None, None), (4, "the cat sat on the mat today again", None, "a", "x", 1, "r", 1),
        (4, "the cat sat on the mat today again", None, "a", "x", 1, "r", 1), (None, "the cat sat on the mat today again", "en", "b", "x", 1, "r", 1), (5, LONG, "la", "b", "x", 1, "r", 1), (6, "123 ... !!!", "en", None, "x", 1, "r", 1),
        (7, "Ünïcödé 日本語 🙂 İ, T̈x", "de", "c", "x", 1, "r", 1), (None, None, None, None, None, None, None, None), (8, "two words", "en", "c", "x", 1, "r", 1),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def empty(odd):
    return odd.limit(0)


def test_token_counts_and_shards_match_the_library(spark, small, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {k: tokenizer.encode(v, add_special_tokens=False).ids for k, v in docs.items()}
    for r in queries.op5_token_counts(spark, small).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 2048)
    start, rows = 0, {r.doc_id: r for r in queries.op2_sstable_shards(spark, small).collect()}
    for k in sorted(docs):
        own = [*ids[k], 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(rows) == len(docs)


@pytest.mark.parametrize("text", ["", "it's, we'll. <|endoftext|> <|ENDOFTEXT|>!", "İ, T̈x ẗ. ΑΣ σς. ﬁ ½ x,y a.b...", "日本語 \x1c \x85  naïve! Ünï", "a" * 3000 + ", b"])
def test_words_encode_as_the_whole_text(text):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    words = wordpieces.split(pa.array(["x", None, text]))[2]
    known = wordpieces.memo(path, "packed").know(words)
    made = np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist()
    assert made == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_of_a_batch_are_those_of_its_texts():
    from tokenizers import Tokenizer

    path, chance = P.path("word_bpe_49k.json"), random.Random(3)
    library, memo = Tokenizer.from_file(path), wordpieces.memo(path, "packed")
    odd = ["", None, " \t", "a$$$ b%%% cé$ ﬁ~ ΑΣ] x's' <|endoftext|>) a<| b|> c=\u0338 ½* ²- 日本) ʰ_", "x", " y.", "İ$$$ e\u0301$"]
    odd += ["".join(chance.choice("ab éÉΣ日½<|>$%'=~.,\u0301\u0338\n ") for _ in range(80)) for _ in range(200)]
    for kind in (pa.string(), pa.large_string()):
        ids, offsets = wordpieces.encode(pa.array(["before", *odd], kind).slice(1), memo)
        made = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert made == [library.encode(t or "", add_special_tokens=False).ids for t in odd]
    other = wordpieces.memo(P.path("piece_bpe_32k.model"), "packed")
    ids, offsets = wordpieces.encode(pa.array(["a b", None, "c d é"]), other)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == list(other.encode(["a b", "", "c d é"]))


def test_a_shard_looks_up_each_different_word_of_a_batch_once(monkeypatch, tmp_path):
    asked, know = [], wordpieces.Memo.know
    monkeypatch.setattr(wordpieces.Memo, "know", lambda self, words: asked.extend(words) or know(self, words))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a cat. " * 5000, "A  cat"], "shard": pa.array([0, 0], pa.int32())})
    (made,) = sstable._write(iter([batch]), str(tmp_path), P.path("word_bpe_49k.json"), 2, 2)
    assert sorted(asked) == [b".", b"a", b"cat"]
    assert [(i, len(ids)) for i, ids in sstable.Table(made.column("path")[0].as_py())] == [(1, 15_001), (2, 3)]


def test_a_memo_is_asked_without_a_walk_over_what_it_holds():
    class Unwalked(dict):
        def __iter__(self):
            raise AssertionError("all words of the memo are walked")

    memo = wordpieces.Memo(*wordpieces.library(P.path("word_bpe_49k.json")), lambda ids: ids)
    memo.young = Unwalked(memo.know([b"cat", b"dog"]))
    assert len(memo.know([b"cat", b"bird"])[b"bird"]) >= 4


def test_words_that_end_in_punctuation_share_the_encoding_of_their_letters():
    memo = wordpieces.Memo(*wordpieces.library(P.path("word_bpe_49k.json")), lambda ids: ids)
    sent, encode = [], memo.encode
    memo.encode = lambda texts: sent.extend(texts) or encode(texts)
    words = [b"cat$$$", b"dog$$$", b"bird$$$"]
    known = memo.know(words)
    assert sent == ["$$$"] and len({known[w] for w in words}) == 3


def test_segments_join_to_the_text_and_cut_at_space():
    text = (b"ab cd\tef\n" * 1000) + b"x" * 5000 + b" y"
    parts = list(token_counts.segments(text, 500))
    assert b"".join(parts) == text
    assert all(len(p) <= 500 or b"x" * 5000 in p for p in parts)
    assert [w for p in parts for w in p.split()] == text.split()


def test_counts_of_odd_rows(odd):
    rows = token_counts.token_counts(odd, P.path("word_bpe_49k.json")).collect()
    assert len(rows) == 11 and sum(r.n_tokens == 0 for r in rows) == 3
    assert {r.doc_id: r.over_limit for r in rows}[5]
    assert token_counts.token_counts(empty(odd), P.path("word_bpe_49k.json")).collect() == []
    other = token_counts.token_counts(odd, P.path("piece_bpe_32k.model")).collect()
    assert len(other) == 11


def test_shards_look_up_by_key(odd, spark):
    manifest = sstable.write_shards(odd, P.path("word_bpe_49k.json"), shards=3).collect()
    tables = [sstable.Table(r.path) for r in manifest]
    found = [x for t in tables for x in t.get(4)]
    assert len(found) == 2 and found[0][-1] == 2
    assert sum(len(t.get(None)) for t in tables) == 2 and not any(t.get(999) for t in tables)
    order = [i for t in tables for i, _ in t]
    assert order == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert sstable.read_shards(sstable.write_shards(empty(odd), P.path("word_bpe_49k.json"))).collect() == []


def test_ids_that_do_not_fit_are_an_error_and_wide_ones_come_back(spark, tmp_path):
    writer = sstable.Writer(2)
    with pytest.raises(ValueError):
        list(writer.add(1, np.array([70_000], np.uint32)))
    writer = sstable.Writer(4)
    parts = [*writer.add(1, np.array([70_000], np.uint32)), *writer.finish()]
    (tmp_path / "wide").write_bytes(b"".join(parts))
    assert sstable.Table(str(tmp_path / "wide")).get(1)[0].tolist() == [70_000]
    docs = spark.createDataFrame([(1, "a cat")], "doc_id long, text string")
    folder = str(tmp_path / "shards")
    (row,) = sstable.write_shards(docs, P.path("word_bpe_49k.json"), end_id=99_999, folder=folder).collect()
    assert row.path.startswith(folder) and sstable.Table(row.path).get(1)[0][-1] == 99_999


def test_safe_boundaries_are_told_from_the_file_itself(tmp_path):
    import json

    path = P.path("word_bpe_49k.json")
    spec = json.load(open(path))
    (tmp_path / "renamed.json").write_text(json.dumps(spec))
    assert wordpieces.splits_at_space(path) and wordpieces.splits_at_space(str(tmp_path / "renamed.json"))
    assert not any(wordpieces.splits_at_space(P.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += "|\\s+"
    (tmp_path / "word_bpe_49k.json").write_text(json.dumps(spec))
    assert not wordpieces.splits_at_space(str(tmp_path / "word_bpe_49k.json"))


def test_a_shard_of_many_blocks_finds_every_key(tmp_path):
    writer, parts = sstable.Writer(4), []
    for i in range(-500, 500):
        parts += writer.add(i * 3, np.full(700, i & 0xFFFF, np.uint32))
    parts += writer.finish()
    path = tmp_path / "shard"
    path.write_bytes(b"".join(parts))
    t = sstable.Table(str(path))
    assert len(t.blocks) > 5 and t.documents == 1000
    assert all(t.get(i * 3)[0][0] == i & 0xFFFF and not t.get(i * 3 + 1) for i in range(-500, 500, 7))
    path.write_bytes(b"".join(parts)[:-60] + bytes(60))
    with pytest.raises(ValueError):
        sstable.Table(str(path))


def test_exact_dedup_matches_brute_force(spark, small, docs):
    groups = {}
    for k, v in docs.items():
        groups.setdefault(v, []).append(k)
    for r in queries.op6_exact_dedup(spark, small).collect():
        own = groups[docs[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_exact_dedup_of_odd_rows_even_if_all_keys_collide(odd):
    for key in (None, F.lit(7).cast("long")):
        rows = exact_dedup.exact_duplicates(odd, capacity=2, owners=3, key=key).collect()
        assert len(rows) == 11
        cat = [r for r in rows if r.text_sha256 == hashlib.sha256(b"the cat sat on the mat today again").hexdigest()]
        assert len(cat) == 4 and all((r.keep_id, r.group_size) == (4, 4) and r.kept == (r.doc_id == 4) for r in cat)
        blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
        assert len(blank) == 3 and {r.keep_id for r in blank} == {2}
    assert exact_dedup.exact_duplicates(empty(odd)).collect() == []


def test_extendible_hash_doubles_splits_and_chains(tmp_path):
    index = exact_dedup.ExtendibleHash(4)
    keys = [zlib.crc32(str(i).encode()) for i in range(2000)] + [99] * 10
    for i, key in enumerate(keys):
        index.insert(key, (bytes(32), True, i, 1, 0))
    assert index.depth > 5 and len(index.directory) == 1 << index.depth
    path = tmp_path / "index"
    path.write_bytes(b"".join(index.dump()))
    again = exact_dedup.ExtendibleHash.load(str(path))
    assert all(any(v[2] == i for v in again.lookup(key)) for i, key in enumerate(keys)) and len(again.lookup(99)) == 10 and again.lookup(98) == []


def shingles(text, n):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(texts, n, threshold=0.8):
    sets, found = {k: shingles(v, n) for k, v in texts.items()}, {k: k for k in texts}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                found[y] = x
    return {k: root(k) for k in keys}, sets


def test_near_dedup_matches_brute_force(spark, small, docs):
    want, sets = brute_components(docs, 4)
    for r in queries.op3_minhash_near_dedup(spark, small).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)


def test_near_dedup_of_a_large_group_of_edited_copies(spark):
    draw = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(700):
        words = list(base)
        for at in draw.choice(120, draw.integers(0, 9), replace=False):
            words[at] = f"n{draw.integers(40)}"
        texts[i] = " ".join(words)
    want, _ = brute_components(texts, 5)
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    wrong = sum(r.component_id != want[r.doc_id] for r in rows)
    assert wrong == 0 and len(set(want.values())) > 20


def test_near_dedup_of_odd_rows(odd):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[4].component_id == 3 and not by[4].kept and by[3].kept
    assert by[1].n_shingles == 0 and by[1].kept and by[8].n_shingles == 1
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(empty(odd)).collect() == []


def test_odd_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    from gridloom.llm import textnum

    a, b = textnum.seeds(96, 3) | np.uint64(1), textnum.seeds(96, 4)
    for similarity in (0.9, 0.7):
        far = []
        for _ in range(60):
            common, n = draw.integers(0, 2**63, 400).astype(np.uint64), round(400 * (1 - similarity) / similarity / 2)
            x, y = (near_dedup.odd_sketch(near_dedup._minhash(np.concatenate([common, draw.integers(0, 2**63, n).astype(np.uint64)]), a, b)) for _ in range(2))
            far.append(sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)))
        assert abs(np.mean(far) - near_dedup.sketch_distance(similarity)) < 4


PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def test_license_base_matches_brute_force(spark, medium):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = queries.op4_license_scan(spark, medium).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(lower))
        at = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_overlap_by_priority(spark, odd):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0"), (2, "SPDX-License-Identifier: GPL-3.0-only"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (4, "a licence without a name"), (5, "cc by nc cc by nc CC-BY-NC"), (6, "mit license " * 3000), (7, "released under the BSD 3-Clause License and the GNU LGPL v2.1"),
    ]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(1, 8)] == ["apache-2", "gpl-3.0", "mit", "", "cc-by-nc", "mit", "bsd-3-clause,lgpl-2.1"]
    assert rows[5].n_base == 3 and (rows[5].first_word, rows[5].last_word) == (0, 6)
    assert len(licenses.scan(odd).collect()) == 11 and licenses.scan(empty(odd)).collect() == []


def test_license_matches_pass_gate_and_keywords(spark):
    texts = [
        ("under MPL v2.0", "mpl-2.0"), ("MPL version 1.1", "mpl-1.1"), ("EPL v2.0", "epl-2.0"), ("EUPL v1.2", "eupl-1.2"), ("CDDL version 1.0", "cddl-1.0"), ("MIT No Attribution", "mit-0"), ("SPDX-License-Identifier: GFDL-1.3-or-later", "gfdl"),
        ("License: CPL-1.0", "cpl-1.0"), ("License: PSF-2.0", "python-2.0"), ("Released under the Expat License", "mit"), ("X11 license", "mit"), ("released to you under mit", "mit"), ("confidential and proprietary", "proprietary"), ("mit mpl and cpl", ""),
    ]
    rows = licenses.scan(spark.createDataFrame([(t, t) for t, _ in texts], "doc_id string, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == dict(texts)
    rules = licenses.license_rules.rules()
    gate = licenses.license_rules.gate(rules)
    for rule in rules:
        for text in licenses.license_rules._written(rule.pattern.removeprefix("(?<= )").removesuffix("(?= )")):
            norm = f" {text.replace(licenses.license_rules.ANY, 'x')} "
            assert re.search(rule.pattern, norm) and any(w in norm for w in gate) and any(w in norm for w in rule.keywords)


def brute_scan(text):
    """Labels and score of a text, worked out without gate, keywords or windows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
    norm, found = f" {' '.join(words)} ", []
    for rule in licenses.license_rules.rules():
        found += [(m.start(), m.end(), rule) for m in re.finditer(rule.pattern, norm)]
    rank = lambda d: (d[2].priority, d[1] - d[0], -d[2].number)
    kept = [r for a, b, r in found if not any(x <= a and y >= b and rank((x, y, q)) > rank((a, b, r)) for x, y, q in found)]
    base = {label for p, label in PHRASES if f" {p} " in norm}
    return ",".join(sorted({r.label for r in kept} | base)), max([r.confidence for r in kept] + [0.9] * bool(base), default=0.0)


def test_license_labels_and_scores_of_the_table_match_brute_force(spark, medium):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op4_license_scan(spark, medium).collect()
    some = {r.doc_id: (r.labels, r.score) for r in rows}
    assert len(some) == len(texts)
    # Without any of these letters no rule's phrase can stand in a text; the others are all worked out.
    gate = licenses.license_rules.gate(licenses.license_rules.rules())
    norm = {i: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " " for i, t in texts.items()}
    for i, t in texts.items():
        if i % 10 == 0 or any(w in norm[i] for w in gate):
            assert some[i] == brute_scan(t), i
        else:
            assert some[i] == ("", 0.0)
    assert sum(bool(labels) for labels, _ in some.values()) > 10


def test_license_letters_that_lower_to_ascii(spark):
    texts = ["Released under the \u212aDE \u0130SC License", "zl\u0130b License", "ÀÉ under the MIT License ÉÀ", "\u212a under the MIT License", "LİCENSED under MPL v2.0", "Publi\u212a"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score) for r in rows} == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_words, r.first_word) for r in rows if r.n_base} == {2: (6, 1), 3: (5, 1)}


def test_every_license_rule_finds_what_it_says(spark):
    rules, texts = licenses.license_rules.rules(), []
    for rule in rules:
        written = licenses.license_rules._written(rule.pattern.removeprefix("(?<= )").removesuffix("(?= )"))
        texts += [(len(texts) + i, written[j].replace(licenses.license_rules.ANY, "x"), rule.number) for i, j in enumerate({0, len(written) // 2, len(written) - 1})]
    found = licenses.detections(spark.createDataFrame(texts, "doc_id long, text string, rule int")).filter("label IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("label", "priority", "start", "end")).alias("all")).collect()
    by = {r.doc_id: {tuple(x) for x in r["all"]} for r in found}
    assert len(rules) > 500 and len({r.pattern for r in rules}) == len(rules)
    for i, text, number in texts:
        rule = rules[number]
        assert (rule.label, rule.priority, 1, 1 + len(text)) in by.get(i, set()), (text, rule)


def test_license_suppression_matches_brute_force(spark):
    draw = np.random.default_rng(2)
    words = "licensed released under the terms of mit license apache version 2 0 gnu gpl v3 spdx identifier bsd style cc by nc".split()
    texts = [(i, " ".join(draw.choice(words, 60))) for i in range(60)]
    rules = licenses.license_rules.rules()
    got = {}
    for r in licenses.detections(spark.createDataFrame(texts, "doc_id long, text string")).filter("kept").collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end, r.label, r.priority))
    for i, text in texts:
        norm, found = f" {text} ", []
        for rule in rules:
            found += [(m.start(), m.end(), rule) for m in re.finditer(rule.pattern, norm)]
        rank = lambda d: (d[2].priority, d[1] - d[0], -d[2].number)
        kept = {(a, b, r.label, r.priority) for a, b, r in found if not any(x <= a and y >= b and rank((x, y, q)) > rank((a, b, r)) for x, y, q in found)}
        assert got.get(i, set()) == kept


def test_language_id(spark, medium):
    rows = queries.op1_language_id(spark, medium).collect()
    real = {r.doc_id: r.lang for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == real[r.doc_id] for r in held) / len(held) > 0.98


def plain_grams(text):
    """Buckets of a text's n-grams, one character at a time."""
    mask, found = 0xFFFFFFFF, []
    points = [ord(ch) if ch.isalpha() else 32 for ch in text.lower()]
    for order in langid.ORDERS:
        for i in range(len(points) - order + 1):
            own, h = points[i : i + order], 0
            if any(x != 32 for x in own):
                for j, x in enumerate(own):
                    h = (((h ^ (h >> 15)) * 0x85EBCA77) + x * 0x9E3779B1 + j + 1) & mask
                h = ((h ^ (h >> 16)) * 0xC2B2AE3D) & mask
                found.append(h >> 17)
    return Counter(found)


def test_language_id_matches_a_plain_fit_and_decoding(spark, small):
    import xxhash

    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    grams = {r.doc_id: plain_grams(r.text or "") for r in rows}
    train = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names = sorted({r.lang for r in train})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fold = {r.doc_id: signed(xxhash.xxh64(r.text.encode(), seed=42).intdigest()) % 10 for r in train}
    code = langid.codewords(len(names)).astype(int).tolist()
    bits = range(len(code[0]))

    def weigh(own):
        counts = {n: Counter() for n in names}
        for r in own:
            counts[r.lang].update(grams[r.doc_id])
        total = {n: sum(counts[n].values()) + 0.5 * langid.BUCKETS for n in names}
        def weight(bucket, bit):
            sides = {1: [], -1: []}
            for n, word in zip(names, code):
                sides[word[bit]].append((counts[n][bucket] + 0.5) / total[n])
            return max(-5.0, min(5.0, math.log(sum(sides[1]) / len(sides[1])) - math.log(sum(sides[-1]) / len(sides[-1]))))
        seen = {}
        def margins(doc_id):
            n = max(1, sum(grams[doc_id].values()))
            return [sum(k * (seen[b, j] if (b, j) in seen else seen.setdefault((b, j), weight(b, j))) for b, k in grams[doc_id].items()) / n for j in bits]
        return margins

    first, whole = weigh([r for r in train if fold[r.doc_id] != 0]), weigh(train)
    right, seen, size = {n: [0] * len(bits) for n in names}, Counter(), [0.0] * len(bits)
    for r in train:
        if fold[r.doc_id] == 0 and grams[r.doc_id]:
            seen[r.lang] += 1
            for j, m in enumerate(first(r.doc_id)):
                right[r.lang][j] += m * code[names.index(r.lang)][j] > 0
                size[j] += abs(m)
    scale = [s / sum(seen.values()) for s in size]
    trust = [[(x + 1) / (seen[n] + 2) for x in right[n]] if seen[n] else [1.0] * len(bits) for n in names]
    for r in queries.op1_language_id(spark, small).collect():
        if not grams[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        scaled = [max(-3.0, min(3.0, m / s)) for m, s in zip(whole(r.doc_id), scale)]
        far = [sum(t * math.exp(-x * c) for t, x, c in zip(own, scaled, word)) / sum(own) for own, word in zip(trust, code)]
        assert r.lang_pred == names[far.index(min(far))]
        assert math.isclose(r.score, 1 / sum(math.exp(-4 * (d - min(far))) for d in far), rel_tol=1e-3)


def test_language_id_learns_every_language(spark):
    draw = np.random.default_rng(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    own = {f"l{i:03}": [letters[j] for j in draw.choice(3000, 12, replace=False)] for i in range(300)}
    rows = [(n, "".join(draw.choice(chars + [" "], 120))) for n, chars in own.items() for _ in range(1 if n < "l100" else 4)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(train)
    assert model.languages == sorted(own)
    asked = spark.createDataFrame([(n, "".join(draw.choice(chars, 80))) for n, chars in own.items()], "lang string, text string")
    assert sum(r.lang == r.lang_pred for r in langid.predict(asked, model, id_col="lang").collect()) >= 295
    assert all(r.lang == r.lang_pred for r in langid.predict(train, model, id_col="lang").collect() if r.lang < "l100")


def test_language_id_of_odd_rows(odd, spark):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == 11 and {r.doc_id: r.lang_pred for r in rows}[6] == "und"
    assert all(r.lang_pred in (*model.languages, "und") for r in rows) and sum(r.lang_pred == "und" for r in rows) == 4
    none = langid.fit(empty(odd))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    one = langid.fit(odd.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(odd, one).collect()} == {"en", "und"} and langid.predict(empty(odd), one).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 100])
def test_codewords_are_apart(n):
    code = langid.codewords(n).astype(int)
    far = (code.shape[1] - code @ code.T) // 2
    assert far[~np.eye(n, dtype=bool)].min() >= (1 if n < 3 else 2 if n < 4 else 4)
    assert np.abs(code.sum(axis=0)).max() < n


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    margins = code.astype(float).copy()
    margins[:, 0] *= -1
    best, score, ambiguous = langid.decode(margins, model)
    assert best.tolist() == [0, 1, 2, 3, 4] and not ambiguous.any() and (score > 0.2).all()
    assert langid.decode(np.zeros((1, code.shape[1])), model)[2].all()


def test_mixing_meets_targets(spark, medium):
    rows = queries.op8_source_mixing(spark, medium).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
        assert r.taken <= 2 * r.size
    total = sum(size.values())
    assert math.isclose(sum(target.values()), 1.5 * total) and all(t <= 2 * size[s] + 1e-6 for s, t in target.items())
    assert all(abs(taken[s] - t) <= 0.15 * t + 3000 for s, t in target.items())
    assert sorted(rows) == sorted(queries.op8_source_mixing(spark, medium).collect())


def test_mixing_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and {r.source_size for r in rows if r.doc_id == 2} == {3}
    assert mixing.mix(empty(odd)).collect() == [] and mixing.resample(empty(odd)).collect() == []
    again = mixing.resample(odd)
    assert again.columns == odd.columns and 0 < again.count() <= 22


def test_bpe_matches_tiktoken(spark, small, docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_byte_bpe(spark, small).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    draw = np.random.default_rng(4)
    vocabulary = bpe.vocabulary(path)
    for alphabet in ("abcdefghij", "aab", "theringtion", "éüß日🙂 ", "0123", "\n\t  a"):
        for _ in range(300):
            piece = "".join(draw.choice(list(alphabet), draw.integers(1, 80)))
            assert vocabulary._walk(piece.encode().decode("latin-1")) == library._encode_single_piece(piece)
    long = "abcab" * 20_000
    assert vocabulary._walk(long) == library._encode_single_piece(long)


def test_bpe_of_odd_rows_comes_back(odd):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(odd, path, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in bpe.decode(ids, path).collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert bpe.encode(empty(odd), path, P.PATTERN).collect() == []


def test_language_model_base_and_gain(spark, small, docs):
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    words = {k: [*v.encode().lower().split(), None] for k, v in docs.items()}
    counts = Counter(w for k, v in words.items() if not held(k) for w in v)
    n, distinct = sum(counts.values()), len(counts)
    rows = queries.op10_maxent_lm(spark, small).collect()
    for r in rows:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words[r.doc_id]), sum(w in counts for w in words[r.doc_id]), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_probabilities_add_up():
    lexicon = language_model.Lexicon(0, 0, np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.log10(np.full(language_model.ENDINGS, 0.5)))
    weights = language_model.initial(lexicon)
    chances = language_model._chances(language_model._outer(weights, [np.zeros(1, np.uint16)] * 5))
    assert math.isclose(chances.sum(), 1, rel_tol=1e-5)


def test_language_model_scores_match_its_weights_and_chances_add_up(spark, small, docs):
    """Scores worked out token by token from the fitted weights, and all chances after a history summed."""
    train = spark.read.parquet(f"{small}/documents.parquet")
    model = language_model.fit(train)
    lexicon, weights = model.lexicon, [w.astype(float) for w in model.weights]
    counts = {r.word: r.n for r in model.counts.collect()}
    got = {r.doc_id: r.score for r in language_model.score(train, model).collect()}
    width, frequent = language_model.WIDTH, language_model.frequent_classes(lexicon.tokens)
    softmax = lambda z: np.exp(z - np.logaddexp.reduce(z))
    for doc_id in sorted(docs)[:12]:
        t = language_model.tokens(pa.array([docs[doc_id][:4000]]))
        x, total = language_model.examples(t, lexicon), 0.0
        for i, word in enumerate(t.hashes):
            outer = softmax(sum(weights[j][x.rows[j][i]] for j in range(3)) + weights[5][0])
            chance = outer[x.kind[i]]
            if x.inner[i] >= 0:
                chance *= softmax(weights[3][x.rows[3][i]] + weights[4][x.rows[4][i]] + weights[6][x.kind[i]])[x.inner[i]]
            else:
                share = 10 ** lexicon.shares[x.kind[i] - frequent]
                chance *= (counts.get(int(np.int64(word.view(np.int64))), 0) + 0.5) / share
            total += math.log10(chance)
        if len(docs[doc_id]) <= 4000:
            assert math.isclose(got[doc_id], total, rel_tol=1e-4)
    # Within a class by ending: its words outside the frequent classes, and one place for all unknown words.
    slots = dict(zip(lexicon.words.view(np.int64).tolist(), lexicon.slots.tolist(), strict=True))
    endings, held = Counter(), Counter()
    for text in docs.values():
        t = language_model.tokens(pa.array([text]))
        endings.update(dict(zip(t.hashes.view(np.int64).tolist(), t.ending.tolist(), strict=True)).items())
    for (word, ending), _ in endings.items():
        if slots.get(word, -1) < 0:
            held[ending] += counts[word] + 0.5
    assert all(math.isclose(held[e] + 0.5, 10 ** lexicon.shares[e], rel_tol=1e-6) for e in range(language_model.ENDINGS))
    assert (np.bincount(lexicon.slots[lexicon.slots >= 0], minlength=frequent * width)[: (lexicon.slots >= 0).sum()] == 1).all()


def test_rows_that_are_alike_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b d"), (None, None), (None, None)], "doc_id long, text string")
    model = language_model.fit(docs)
    rows = language_model.score(docs, model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in rows) == [("1", 4, 4), ("1", 4, 4), ("2", 4, 4), ("None", 1, 1), ("None", 1, 1), ("None", 4, 4)]
    assert len({round(r.base_score, 9) for r in rows if r.doc_id == 1}) == 1


def test_language_model_grows_with_its_training_tokens():
    shapes = []
    for n in (1, 1 << 22, 1 << 26, 1 << 32, 1 << 36):
        lexicon = language_model.Lexicon(n, 3, np.array([1, 2, 3], np.uint64), np.array([5, 3, 1]), np.array([0, 1, -1]), np.log10(np.full(language_model.ENDINGS, 0.5)))
        weights = language_model.initial(lexicon)
        t = language_model.Tokens(np.arange(1, 4, dtype=np.uint64), np.full(3, language_model.ENDINGS - 1), np.array([0, 3]))
        x = language_model.examples(t, lexicon)
        assert len(weights[6]) * language_model.WIDTH >= 1024 and x.kind.max() == weights[0].shape[1] - 1 and all(r.max() < len(w) for r, w in zip(x.rows, weights))
        assert np.isclose(np.exp(weights[5]).sum(), 1)
        shapes.append(weights[0].shape)
    assert [rows for rows, _ in shapes] == [4096, 4096, 8192, 65536, 262144] and [width for _, width in shapes] == [48, 48, 56, 68, 76]


def test_language_model_of_odd_rows(odd):
    model = language_model.fit(odd)
    rows = language_model.score(odd, model).collect()
    assert len(rows) == 11 and all(r.n_tokens >= 1 for r in rows) and {r.doc_id: r.n_tokens for r in rows}[5] == 60_001
    untaught = language_model.fit(empty(odd))
    assert all(abs(r.base_score) < 1e-6 and r.n_known == 0 for r in language_model.score(odd, untaught).collect())
    assert language_model.score(empty(odd), model).collect() == []


def test_resample_takes_a_share_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "one two three", "a")] * 40 + [(i, f"text {i}", "b") for i in range(2, 12)], "doc_id long, text string, source string")
    want = {r.source: r.n for r in rows.join(mixing.mix(rows, weights=(1, 8)).groupBy("doc_id").agg(F.sum("copies").alias("n")), "doc_id").select("source", "doc_id", "n").distinct().groupBy("source").agg(F.sum("n").alias("n")).collect()}
    got = Counter(r.source for r in mixing.resample(rows, weights=(1, 8)).collect())
    assert dict(got) == want
