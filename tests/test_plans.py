"""Rules keep results, the search never makes a plan dearer, plans have the shape they claim."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.ml import models
from gridloom.plans import RULES, Aggregate, Call, Filter, Join, Project, Source, cost, optimise
from gridloom.plans.cost import rows
from gridloom.plans.search import actions


@pytest.fixture(scope="module")
def sides(spark):
    draw = np.random.default_rng(0)
    left = spark.createDataFrame([(i, i % 7, draw.standard_normal(20).round(3).tolist()) for i in range(60)], "id long, k int, v array<double>")
    right = spark.createDataFrame([(i, draw.standard_normal(9).round(3).tolist()) for i in range(7)], "rk int, w array<double>")
    return Source("left", left, 60, {"v": 20}), Source("right", right, 7, {"w": 9})


def result(plan):
    return {r.id: [round(x, 6) + 0.0 for x in r.y] for r in plan.lower().select("id", "y").collect()}


def network(sides, classification=False):
    w = np.random.default_rng(1).standard_normal((29, 20)).round(3)
    w[np.abs(w) < 0.8] = 0
    calls = (Call("a", models.MatMul(w), ("v", "w")), Call("b", models.Bias(np.linspace(-1, 1, 20)), ("a",)), Call("c", models.Relu(), ("b",)), Call("y", models.MatMul(np.ones((20, 18))), ("c",)))
    return Project(Filter(Join(*sides, "k", "rk"), "id % 3 = 0", ("id",), 0.33), calls, keep=("id", "y"))


def test_every_rewrite_keeps_the_result(sides):
    plan = network(sides)
    want = result(plan)
    tried = set()
    for name, made in actions(plan):
        tried.add(name)
        assert result(made) == want, name
        for inner, again in actions(made)[:4]:
            assert result(again) == want, (name, inner)
    assert {"product_to_join", "product_to_columns", "fuse_layers", "dense_to_sparse"} <= tried


def test_factorise_and_push_down(sides):
    w = np.random.default_rng(2).standard_normal((29, 4)).round(3)
    plan = Project(Join(*sides, "k", "rk"), (Call("y", models.MatMul(w), ("v", "w")),), keep=("id", "y"))
    (made,) = RULES["factorise"](plan)
    assert result(made) == result(plan)
    assert isinstance(made.child.left, Project) and isinstance(made.child.right, Project) and cost(made) < cost(plan) * 2
    one = Project(Join(*sides, "k", "rk"), (Call("y", models.Relu(), ("v",)),), keep=("id", "y"))
    (down,) = RULES["push_down"](one)
    assert result(down) == result(one) and isinstance(down.child.left, Project)
    assert "ArrowEvalPython" in down.lower()._jdf.queryExecution().executedPlan().toString()


def test_never_below_an_aggregation(sides):
    grouped = Aggregate(sides[0], ("k",), {"v": "first(v)"}, 7)
    assert not list(RULES["push_down"](Project(grouped, (Call("y", models.Relu(), ("v",)),), keep=("k", "y"))))


@pytest.mark.parametrize("classification", [False, True])
def test_forest_as_relation(sides, classification):
    trees = tuple(models.Tree.parse(f"0:[f{i}<0.1] yes=1,no=2,missing=1\n1:leaf={-0.5 - i / 10}\n2:leaf={0.7 + i / 10}") for i in range(3))
    plan = Project(sides[0], (Call("y", models.Forest(trees, classification), ("v",)),), keep=("id", "y"))
    (made,) = RULES["forest_to_relation"](plan)
    assert result(made) == result(plan)
    (back,) = RULES["relation_to_forest"](made)
    assert back.key() == plan.key()


@pytest.mark.parametrize("mode", ["none", "heuristic", "arbitrary", "tree"])
def test_search_never_makes_it_dearer(sides, mode):
    plan = network(sides)
    best = optimise(plan, mode)
    assert cost(best) <= cost(plan) and result(best) == result(plan)
    if mode in ("heuristic", "tree"):
        assert cost(best) < cost(plan)


def test_rows_of_a_join_and_filter(sides):
    assert rows(Join(*sides, "k", "rk", 2.0)) == 120 and rows(Filter(sides[0], "true", (), 0.5)) == 30


def test_kernels_against_numpy(spark):
    from gridloom.ml import kernels as k

    x = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(x,)], "v array<double>")
    get = lambda c: df.select(c.alias("y")).first().y
    e = np.exp(x)
    assert np.allclose(get(k.softmax(F.col("v"))), e / e.sum()) and get(k.argmax(F.col("v"))) == 2
    assert np.allclose(get(models.apply(models.NNBuilder().batch_norm([0] * 3, [1] * 3, [2] * 3, [1] * 3).softmax().argmax().build(), F.col("v"))), [2])
    assert get(k.sequence_pooling(F.array(*map(F.lit, [1.0, 2.0, 3.0, 0.0])), 2, "min")) == [1.0, 0.0]
    with pytest.raises(Exception):  # noqa: B017
        get(k.embedding(F.array(F.lit(9)), [[1.0]]))
    tree = models.Tree.parse("0:[f0<1] yes=1,no=2,missing=2\n1:leaf=1\n2:leaf=2")
    assert tree(np.array([[0.0], [1.0], [np.nan]]))[:, 0].tolist() == [1, 2, 2]
    images = np.arange(32.0).reshape(2, 16)
    assert models.Conv2d((1, 4, 4), np.ones((2, 1, 3, 3)))(images).shape == (2, 8) and models.MaxPool((1, 4, 4), 2)(images)[0].tolist() == [5, 7, 13, 15]


def test_batch_norm_dropout_noise(spark):
    from gridloom.ml import kernels as k

    df = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], "id int, v array<double>")
    made = np.array([r.y for r in k.batch_norm(df, "v", [1, 1], [0, 0], "y").collect()])
    assert np.allclose(made.mean(axis=0), 0, atol=1e-6) and np.allclose(made.std(axis=0, ddof=1), 1, atol=1e-3)
    big = spark.createDataFrame([(list(map(float, range(1, 4001))),)], "v array<double>")
    zeros = sum(v == 0 for v in big.select(k.dropout(F.col("v"), 0.25).alias("y")).first().y)
    assert 850 < zeros < 1150
    noise = np.array(big.select(k.laplace(F.col("v"), 2.0).alias("y")).first().y) - np.arange(1, 4001)
    assert abs(np.abs(noise).mean() - 0.5) < 0.05
    rows_, watch = k.counted(df, "seen")
    rows_.count()
    assert watch.get["rows"] == 10


GRAPH = """digraph {
    graph [ rankdir=TB ]
    0 [ label="f1<2.5" ]
    0 -> 1 [label="yes, missing" color="#0000FF"]
    0 -> 2 [label="no" color="#FF0000"]
    1 [ label="leaf=-0.25" ]
    2 [ label="f0<-1e-1" ]
    2 -> 3 [label="yes"]
    2 -> 4 [label="no"]
    3 [ label="leaf=1.5" ]
    4 [ label="leaf=2" ]
}
"""


def test_a_tree_reads_its_graph_as_its_text():
    text = "0:[f1<2.5] yes=1,no=2,missing=1\n1:leaf=-0.25\n2:[f0<-1e-1] yes=3,no=4,missing=4\n3:leaf=1.5\n4:leaf=2"
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 3, (200, 2)), [[np.nan, 9.0], [0.0, np.nan]]])
    assert (models.Tree.parse(GRAPH)(x) == models.Tree.parse(text)(x)).all()
    for wrong in ("digraph {\n 0 [ label=\"f1<2\" ]\n}", "digraph {\n what is this\n}"):
        with pytest.raises(ValueError):
            models.Tree.parse(wrong)


def test_kernels_over_null_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [-1.0, 5.0])], "i int, v array<double>")
    assert [r.y for r in df.select("i", models.apply(models.Relu(), F.col("v")).alias("y")).orderBy("i").collect()] == [[1.0, 2.0], None, [0.0, 5.0]]
    assert [r.y for r in df.limit(0).select(models.apply(models.Relu(), F.col("v")).alias("y")).collect()] == []


def test_nearest_documents_over_many_blocks(spark):
    from gridloom.ml import retrieval

    draw = np.random.default_rng(1)
    asked, docs = draw.normal(size=(70, 6)), draw.normal(size=(150, 6))
    frame = lambda rows, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{name} long, v array<double>")
    far = ((asked[:, None] - docs[None]) ** 2).sum(axis=2)
    made = retrieval.nearest(frame(asked, "q"), frame(docs, "d"), "q", "v", "d", k=3, block=32).collect()
    assert {(r.q, r.place): r.d for r in made} == {(q, i + 1): int(d) for q in range(70) for i, d in enumerate(np.argsort(far[q])[:3])}
    assert retrieval.nearest(frame(asked, "q").limit(0), frame(docs, "d"), "q", "v", "d").collect() == []


@pytest.mark.parametrize("broken", [
    {"relations": [{"rel": {"cross": {}}}]}, {"relations": [{"rel": {"filter": {"input": {"read": {"namedTable": {"names": ["t"]}}}, "condition": {"scalarFunction": {"functionReference": 9, "arguments": []}}}}}]},
    {"extensions": [{"extensionFunction": {"functionAnchor": 1, "name": "no_such:i64"}}], "relations": [{"rel": {"filter": {"input": {"read": {"namedTable": {"names": ["t"]}}}, "condition": {"scalarFunction": {"functionReference": 1}}}}}]},
])
def test_plans_from_outside_that_are_errors(spark, broken):
    from gridloom.plans import from_substrait

    with pytest.raises(ValueError):
        from_substrait(spark, broken, lambda name: spark.range(3))


def test_a_substrait_plan_reads_files_and_masks_measures(spark, tmp_path):
    from gridloom.plans import from_substrait

    path = str(tmp_path / "rows")
    spark.range(10).selectExpr("id AS a", "id % 2 = 0 AS even").write.parquet(path)
    field = lambda i: {"selection": {"directReference": {"structField": {"field": i}}}}
    read = {"read": {"baseSchema": {"names": ["a", "even"], "struct": {"types": [{"i64": {}}, {"bool": {}}]}}, "localFiles": {"items": [{"uriFolder": path, "parquet": {}}]}}}
    measures = [{"measure": {"functionReference": 1, "arguments": [{"value": field(0)}]}, "filter": field(1)}, {"measure": {"functionReference": 2, "arguments": [{"value": field(1)}], "invocation": "AGGREGATION_INVOCATION_DISTINCT"}}]
    plan = {"extensions": [{"extensionFunction": {"functionAnchor": i, "name": n}} for i, n in ((1, "sum:i64"), (2, "count:any"))], "relations": [{"rel": {"aggregate": {"input": read, "measures": measures}}}]}
    assert tuple(from_substrait(spark, plan, None).first()) == (20, 2)


def test_join_orders_that_are_errors(spark):
    from gridloom.plans import join_in_order

    frame = spark.range(3)
    for order in ("[]", '[{"ID": "0", "Left": "a", "Right": "x", "ProbeKeys": "id", "BuildKeys": "id"}]'):
        with pytest.raises(ValueError):
            join_in_order(order, {"a": frame})
    same = join_in_order('[{"ID": "0", "Left": "a", "Right": "b", "ProbeKeys": "id", "BuildKeys": "id"}]', {"a": frame, "b": frame.selectExpr("id", "id * 2 AS twice")})
    assert sorted(map(tuple, same.collect())) == [(0, 0), (1, 2), (2, 4)]


def test_sides_with_vectors_are_not_broadcast(spark, sides):
    def joins(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]  # the last one, of the sizes met
        return "SortMergeJoin" in plan, "BroadcastHashJoin" in plan

    assert joins(Join(*sides, "k", "rk").lower()) == (True, False)
    names = Source("names", spark.createDataFrame([(i, f"n{i}") for i in range(7)], "lid int, name string"), 7)
    assert joins(Join(sides[0], names, "k", "lid").lower()) == (False, True)


@pytest.mark.parametrize("name, keys", [(f"wl_two_tower_{mode}", "ui") for mode in ("none", "factorise", "tree", "heuristic")] + [(f"wl_fraud_{mode}", ("sender",)) for mode in ("none", "relation", "tree")])
def test_workloads_shuffle_their_vectors(spark, small, name, keys):
    from gridloom import queries as registry

    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert all(f"SortMergeJoin [{key}#" in plan for key in keys)
