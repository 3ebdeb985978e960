"""Embedding near-duplicates, components and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from gridloom.llm import embedding_dedup, graph, queries


def brute_links(rows, threshold=0.93):
    vectors = {i: np.array(v, float) / np.linalg.norm(v) for i, v, _ in rows}
    labels = {i: k for i, _, k in rows}
    ids = list(vectors)
    m = np.array([vectors[i] for i in ids])
    near = (m @ m.T >= threshold) & np.array([[labels[a] == labels[b] for b in ids] for a in ids])
    np.fill_diagonal(near, False)
    return ids, near


def test_embeddings_match_brute_force(spark):
    draw = np.random.default_rng(0)
    centres = draw.standard_normal((30, 24))
    rows = []
    for i in range(600):
        v = centres[i % 30] + draw.standard_normal(24) * draw.choice([0.02, 0.15, 0.3])
        rows.append((i, v.tolist(), int(i % 3 if i % 30 else 1)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ids, near = brute_links(rows)
    found = sum(got[i].n_links for i in ids)
    assert found <= near.sum() and found >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[a].sum() for a, i in enumerate(ids))
    assert all(got[1000 + i].component_id == 5 and not got[1000 + i].kept for i in range(40))


def test_vectors_of_every_length_link(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(16).tolist(), 1) for i in range(60)]
    rows += [(100 + i, draw.standard_normal(5).tolist(), 1) for i in range(20)]
    rows += [(200, rows[60][1], 1), (201, [x * 2 for x in rows[61][1]], 1), (202, rows[60][1], 2), (300, [3.0], 1), (301, [5.0], 1), (302, [-1.0], 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[200].component_id == 100 and got[201].component_id == 101 and got[202].n_links == 0
    assert (got[301].component_id, got[301].n_links, got[302].n_links) == (300, 1, 0)


def test_a_large_group_of_near_vectors_counts_every_link(spark):
    draw = np.random.default_rng(4)
    centre = draw.standard_normal(64)
    rows = [(i, (centre + 0.12 * draw.standard_normal(64)).tolist(), 1) for i in range(1500)] + [(5000 + i, draw.standard_normal(64).tolist(), 1) for i in range(300)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ids, near = brute_links(rows)
    assert sum(got[i].n_links for i in ids) >= 0.97 * near.sum() > 1_000_000
    assert all(got[i].n_links <= near[a].sum() for a, i in enumerate(ids)) and {got[i].component_id for i in range(1500)} == {0}


@pytest.mark.parametrize("shared", [0.0, 0.6, 0.8])
def test_recall_where_vectors_share_a_direction(spark, shared):
    draw = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    whole = unit(np.sqrt(1 - shared) * unit(draw.standard_normal((1000, 64))) + np.sqrt(shared) * unit(draw.standard_normal(64)))
    off = draw.standard_normal((1000, 64))
    off = unit(off - (off * whole).sum(axis=1, keepdims=True) * whole)
    twins = 0.94 * whole + np.sqrt(1 - 0.94**2) * off
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*whole, *twins])]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ids, near = brute_links(rows)
    assert near.sum() >= 2000 and sum(got.values()) >= 0.93 * near.sum()
    assert all(got[i] <= near[a].sum() for a, i in enumerate(ids))


def test_recall_of_the_largest_table(spark):
    """Every 50th vector against all, each with a planted neighbour, as the table itself has few."""
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    draw, planted = np.random.default_rng(7), []
    for i, v, label in rows:
        if i % 50 == 0:
            off = draw.standard_normal(len(v))
            off -= off @ v / (v @ v) * v
            cosine = draw.uniform(0.931, 0.99)
            planted.append((10_000_000 + i, cosine * v + np.sqrt(1 - cosine**2) * np.linalg.norm(v) * off / np.linalg.norm(off), label))
    every = rows + planted
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), k) for i, v, k in every], "vec_id long, embedding array<double>, label int")).collect()}
    m, labels = np.array([v / np.linalg.norm(v) for _, v, _ in every]), np.array([k for _, _, k in every])
    wanted = found = 0
    for a, (i, _, k) in enumerate(every):
        if i % 50 == 0:
            n = int(((m @ m[a] >= 0.93) & (labels == k)).sum()) - 1
            assert got[i] <= n
            wanted, found = wanted + n, found + got[i]
    assert wanted >= len(planted) and found >= 0.95 * wanted


def test_odd_vectors_link_with_nothing(spark):
    good = [float(i) for i in range(8)]
    rows = [(1, good, 1), (2, good, 1), (3, None, 1), (4, [0.0] * 8, 1), (5, [*good[:7], None], 1), (6, [*good[:7], float("nan")], 1), (7, good, None), (None, good, 1), (8, good[:4], 1), (9, [x * 3 for x in good], 1), (2, good, 1), (10, good, 2)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (9, 3, 1, False), (None, 0, None, True), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))]
    assert out == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_whole_embedding_table(spark, small):
    rows = queries.op7_itq_embedding_dedup(spark, small).collect()
    ids, near = brute_links([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()])
    want = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert {r.vec_id: r.n_links for r in rows} == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (None, 3), (101, 100)], [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22), (22, 20)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = want.get(a, a), want.get(b, b)
            low = min(x, y)
            for n in [k for k, v in want.items() if v in (x, y)] + [a, b]:
                want[n] = low
    assert found == want


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_against_brute_force(spark, small, tmp_path):
    import base64

    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "... 12", "en", "src1", 6), (9003, None, None, None, None)], docs.schema)
    now, seen = docs.union(odd), []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        path = str(tmp_path / name)
        stage(spark, now, small).write.parquet(path)
        now = spark.read.parquet(path)
        seen.append((before.collect(), now.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    (a0, a1), (b0, b1), (c0, c1), (d0, d1), (_, e1) = seen
    assert {r.doc_id for r in a0} - {r.doc_id for r in a1} == {9001, 9002, 9003}
    last = {}
    for r in b0:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in b1) == sorted(last.values())
    sets, root = {r.doc_id: shingles(r.text) for r in c0}, {}
    for i in sorted(sets):
        root[i] = i
        for j in sorted(root):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                low = min(root[i], root[j])
                old = {root[i], root[j]}
                root = {k: low if v in old else v for k, v in root.items()}
    assert sorted(r.doc_id for r in c1) == sorted(set(root.values()))
    times = Counter(r.doc_id for r in d1)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in d0}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in d0}
    assert Counter(r.doc_id for r in e1) == times
    assert all(r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(text[r.doc_id]), "<u4").tobytes()).hexdigest() for r in e1)


def test_pipeline_of_no_documents(spark, small):
    now = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
    assert now.collect() == []


def test_registered_queries_and_sql_have_the_same_names(spark):
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 10
    assert zlib.crc32(b"12") == spark.range(1).selectExpr("crc32(CAST(CAST(12 AS STRING) AS BINARY)) AS c").first().c


def test_pipeline_keeps_unlabelled_documents_with_letters(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the cat sat", None), (2, "12 ...", None), (3, None, None), (4, "日本語", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]


def test_pipeline_stages_take_odd_columns_and_repeated_rows(spark, small):
    """Columns of odd names and types, null ids, repeated rows and a long text: no stage fails, each does what it says."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `key` string, `row` array<int>, m map<string,int>, c0 struct<x:int>, `copies` double, sha_ string"
    tail = (1, "k", [1, None], {"x": 1}, (2,), 0.5, None)
    other = (None, None, None, {}, None, float("nan"), "s")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    near = " ".join(words)
    rows = [
        (1, near, "en", "a", 1, *tail), (1, near, "en", "a", 1, *tail), (2, near, "en", "a", 1, *other), (None, near, None, None, None, *other), (3, near + " one", "en", "a", 1, *tail),
        (4, None, "en", "a", None, *tail), (5, "", None, "b", 0, *tail), (6, "12 ...", "en", "b", 1, *tail), (7, "lorem ipsum dolor sit amet " * 30_000, "la", "b", 1, *tail),
        (None, "quite another text it is", "en", None, 1, *other), (None, "quite another text it is", "en", None, 1, *other), (8, "a third text stands here alone", "en", "c", 1, *tail), (3, "the same id with a text of its own", "en", "a", 1, *tail),
    ]
    docs = spark.createDataFrame(rows, schema)
    texts = lambda df: sorted((str(r.doc_id), (r.text or "")[:20]) for r in df.collect())
    language = corpus_pipeline.language_id(spark, docs, small)
    assert language.columns == docs.columns and dict(language.dtypes) == dict(docs.dtypes) and {r.doc_id for r in docs.collect()} - {r.doc_id for r in language.collect()} == {4, 5, 6}
    assert language.count() == 10
    exact = corpus_pipeline.exact(spark, docs, small)
    assert exact.columns == docs.columns and len({r.text or "" for r in exact.collect()}) == exact.count() == 8
    assert ("2", near[:20]) in texts(exact) and ("None", "quite another text i") in texts(exact) and ("5", "") in texts(exact)
    kept = corpus_pipeline.near(spark, exact, small)
    assert kept.columns == docs.columns and kept.count() == 7 and ("2", near[:20]) in texts(kept) and ("3", "the same id with a t") in texts(kept)
    assert [r.text for r in kept.collect() if r.doc_id == 3] == ["the same id with a text of its own"]
    mixed = corpus_pipeline.mix(spark, docs, small)
    assert mixed.columns == docs.columns and dict(mixed.dtypes) == dict(docs.dtypes) and 0 < mixed.count() <= 2 * docs.count()
    assert set(texts(mixed)) <= set(texts(docs)) and sorted(map(str, mixed.collect())) == sorted(map(str, corpus_pipeline.mix(spark, docs, small).collect()))
    coded = corpus_pipeline.encode(spark, docs, small).collect()
    assert len(coded) == docs.count() and sum(r.n_tokens == 0 for r in coded) == 2


def test_resample_takes_equal_rows_each_on_its_own(spark):
    from gridloom.llm import mixing

    rows = [(1, "one two three four", "a", {"x": 1})] * 90 + [(100 + i, "some words of source b", "b", {}) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    taken = Counter(r.source for r in mixing.resample(docs, weights=(1, 1)).collect())
    assert abs(taken["a"] * 4 - 607.5) <= 4 and abs(taken["b"] * 5 - 607.5) <= 5  # 1.5 times 810 words, halved


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Fake

    from gridloom.llm import _common

    def session(master, folder=None):
        nothing = Fake(isEmpty=lambda: True)
        conf = Fake(get=lambda name, default=None: folder)
        return Fake(conf=Fake(get=lambda name, default=None: None), sparkContext=Fake(master=master, getConf=lambda: conf, _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: nothing))))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            _common.shared_dir(session(master))
    assert _common.shared_dir(session("yarn", "hdfs://all/share/")) == "hdfs://all/share"


def test_partitions_of_small_frames(spark):
    from gridloom.llm import _common

    assert [_common.parts_for(spark, n, 100) for n in (0, 1, 100, 101, 10**9)] == [1, 1, 1, 2, _common.shuffle_partitions(spark)]
