"""Kernels over embeddings, rewritten plans, workloads, and event windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.catalog import tables
from gridloom.ml import kernels as k
from gridloom.ml import models, retrieval
from gridloom.plans import RULES, Call, Join, Project, Source, optimise
from gridloom.workloads import fraud, recommendation

QUERIES = {}


def _rounded(a, digits=8):
    return F.transform(a, lambda x: F.round(x, digits))


def _kernel(name, made, sql=None, table="(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"):
    QUERIES[f"ml_{name}"] = (lambda spark, sf_dir: tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", made(F.col("v")).alias("y")), sql and f"SELECT vec_id, {sql} AS y FROM {table}")


_W = recommendation.weights(64, 6, 5)
_WS = np.where(np.abs(_W) > 0.12, _W, 0.0)
_cols = lambda w: "[" + ", ".join("round(list_dot_product(v, [" + ", ".join(f"{x!r}::DOUBLE" for x in c.tolist()) + "]), 8)" for c in w.T) + "]"
_r = lambda body: f"list_transform({body}, lambda x: round(x, 8))"
_kernel("mat_mul", lambda v: _rounded(models.apply(models.MatMul(_W), v)), _cols(_W))
_kernel("mat_mul_native", lambda v: _rounded(k.mat_mul(v, _W.tolist())), _cols(_W))
_kernel("sparse_mat_mul", lambda v: _rounded(models.apply(models.SparseMatMul(_WS), v)), _cols(_WS))
_kernel("add", lambda v: _rounded(k.add(v, v)), _r("list_transform(v, lambda x: x + x)"))
_kernel("add_scalar", lambda v: _rounded(k.add_scalar(v, 0.5)), _r("list_transform(v, lambda x: x + 0.5)"))
_kernel("relu", lambda v: k.relu(v), "list_transform(v, lambda x: greatest(x, 0))")
_kernel("sigmoid", lambda v: _rounded(k.sigmoid(v)), _r("list_transform(v, lambda x: 1 / (1 + exp(-x)))"))
_kernel("softmax", lambda v: _rounded(k.softmax(v)), "list_transform(v, lambda x: round(exp(x) / list_sum(list_transform(v, lambda z: exp(z))), 8))")
_kernel("argmax", lambda v: k.argmax(v), "list_position(v, list_max(v)) - 1")
_kernel("dot_product", lambda v: _rounded(k.dot_product(v, F.reverse(v))), "[round(list_dot_product(v, list_reverse(v)), 8)]")
_kernel("cosine_similarity", lambda v: F.round(k.cosine_similarity(v, F.reverse(v)), 7), "round(list_dot_product(v, list_reverse(v)) / (list_dot_product(v, v) + 1e-8), 7)")
_kernel("concat", lambda v: k.concat(v, v), "list_concat(v, v)")
_kernel("min_max", lambda v: F.round(k.min_max(F.element_at(v, 1), -1.0, 1.0), 8), "round((v[1] + 1) / 2, 8)")
_kernel("dropout", lambda v: F.forall(F.zip_with(k.dropout(v, 0.3), v, lambda d, x: (d == 0) | (d == x)), lambda fine: fine) & (k.dropout(v, 0.3) == k.dropout(v, 0.3)) & (k.dropout(v, 0.0) == v), "true")
_kernel("embedding", lambda v: k.embedding(F.array(F.pmod("vec_id", F.lit(3)).cast("int"), F.lit(1)), [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]), "list_concat([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]][(vec_id % 3 + 1)::INTEGER], [2.0, 3.0])::DOUBLE[]")
_kernel("sequence_pooling", lambda v: k.sequence_pooling(v, 32, "max"), "list_transform(range(1, 33), lambda i: greatest(v[i], v[i + 32]))")
_kernel("sequence_pooling_mean", lambda v: _rounded(k.sequence_pooling(v, 32, "mean")), _r("list_transform(range(1, 33), lambda i: (v[i] + v[i + 32]) / 2)"))
_kernel("position_encoding", lambda v: _rounded(F.slice(k.position_encoding(v, F.col("vec_id"), 64), 1, 2)), "[round(v[1] + sin(vec_id), 8), round(v[2] + cos(vec_id), 8)]")
_kernel("conv2d", lambda v: _rounded(models.apply(models.Conv2d((1, 8, 8), np.ones((1, 1, 2, 2))), v)), "flatten(list_transform(range(0, 7), lambda r: list_transform(range(0, 7), lambda c: round(v[r * 8 + c + 1] + v[r * 8 + c + 2] + v[r * 8 + c + 9] + v[r * 8 + c + 10], 8))))")
_kernel("max_pool", lambda v: models.apply(models.MaxPool((1, 8, 8), 2), v), "flatten(list_transform(range(0, 4), lambda r: list_transform(range(0, 4), lambda c: greatest(v[r * 16 + c * 2 + 1], v[r * 16 + c * 2 + 2], v[r * 16 + c * 2 + 9], v[r * 16 + c * 2 + 10]))))")
_kernel("tree", lambda v: models.scalar(models.Tree.parse("0:[f0<0.0] yes=1,no=2,missing=1\n1:leaf=-1.5\n2:[f3<0.05] yes=3,no=4,missing=3\n3:leaf=0.25\n4:leaf=2.0"), v), "CASE WHEN v[1] < 0 THEN -1.5 WHEN v[4] < 0.05 THEN 0.25 ELSE 2.0 END::DOUBLE")
_STUMPS = tuple(models.Tree.parse(f"0:[f{i}<0.0] yes=1,no=2,missing=1\n1:leaf=-1\n2:leaf=1") for i in range(4))
_votes = "((CASE WHEN v[1] < 0 THEN -1 ELSE 1 END + CASE WHEN v[2] < 0 THEN -1 ELSE 1 END + CASE WHEN v[3] < 0 THEN -1 ELSE 1 END + CASE WHEN v[4] < 0 THEN -1 ELSE 1 END) / 4)::DOUBLE"
_kernel("forest", lambda v: models.scalar(models.Forest(_STUMPS), v), _votes)
_kernel("forest_classifier", lambda v: models.scalar(models.Forest(_STUMPS, True), v), f"CASE WHEN {_votes} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE")
_kernel("boosted", lambda v: F.round(models.scalar(models.Boosted(_STUMPS, 0.5, True), v), 8), f"round(1 / (1 + exp(-({_votes} * 4 + 0.5))), 8)")
_kernel("fused_network", lambda v: F.round(F.element_at(models.apply(models.NNBuilder().dense(_W, np.full(6, 0.1)).relu().dense(np.ones((6, 1))).build(), v), 1), 7), "round(list_sum(list_transform(" + _cols(_W).replace(", 8)", ", 12)") + ", lambda x: greatest(x + 0.1, 0))), 7)")
_kernel("encoder", lambda v: k.encode(F.pmod("vec_id", F.lit(4)), {0: 7, 1: 8, 2: 9}), "[CASE vec_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE -1 END]")
_kernel("one_hot", lambda v: k.one_hot(F.when(F.col("vec_id") % 2 == 0, "a|c").otherwise("b"), ["a", "b", "c"]), "CASE WHEN vec_id % 2 = 0 THEN [1, 0, 1] ELSE [0, 1, 0] END")
_kernel("token_frequency", lambda v: k.token_frequency(F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(1)), 4), "[0.25::DOUBLE, 0.25, 0.5, 0.0]")
_kernel("ratings_vector", lambda v: k.ratings_vector(F.create_map(F.lit(2), F.pmod("vec_id", F.lit(5)).cast("int")), 3), "[0.0::DOUBLE, (vec_id % 5)::DOUBLE, 0.0]")
_kernel("multi_hot", lambda v: k.multi_hot(F.array(F.lit(1), F.lit(3)), 4), "[0.0::DOUBLE, 0.5, 0.0, 0.5]")
_kernel("conversions", lambda v: F.element_at(k.as_int_vector(k.change_rating(F.pmod("vec_id", F.lit(5)))), 1), "CASE WHEN vec_id % 5 >= 3 THEN 1 ELSE 0 END")
_kernel("laplace_noise", lambda v: (k.laplace(v, 1.0) == k.laplace(v, 1.0)) & (k.laplace(v, 1.0) != v) & F.forall(F.zip_with(k.laplace(v, 1e12), v, lambda d, x: F.abs(d - x) < 1e-9), lambda fine: fine), "true")
_kernel("offline_provider", lambda v: retrieval.complete(F.col("vec_id").cast("string"), retrieval.OfflineProvider()), "'answer-' || substr(sha256(vec_id::VARCHAR), 1, 8)")
QUERIES["ml_batch_norm"] = (
    lambda spark, sf_dir: k.batch_norm(tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", [1.0] * 64, [0.0] * 64, "y").select("vec_id", F.round(F.element_at("y", 1), 6).alias("y")),
    "SELECT vec_id, round((embedding[1] - avg(embedding[1]::DOUBLE) OVER ()) / sqrt(var_samp(embedding[1]::DOUBLE) OVER () + 1e-5), 6) AS y FROM embeddings",
)


def _svd(spark, sf_dir):
    t = tables(spark, sf_dir)
    pairs = t.orders.select("o_orderkey", "o_custkey", F.pmod("o_orderkey", F.lit(120)).alias("item"))
    side = lambda df, key, n: df.filter(F.col(key) < n).select(F.col(key).alias("id"), (F.col(key) / 100).alias("bias"), F.array((F.col(key) % 7).cast("double"), (F.col(key) % 3).cast("double")).alias("factors"))
    return k.svd_score(pairs, side(t.customer, "c_custkey", 100), side(t.supplier, "s_suppkey", 50), "o_custkey", "item", "y").select("o_orderkey", F.round("y", 8).alias("y"))


QUERIES["ml_svd"] = (_svd, """SELECT o_orderkey, round(coalesce(c.c_custkey / 100 + s.s_suppkey / 100 + (c.c_custkey % 7) * (s.s_suppkey % 7) + (c.c_custkey % 3) * (s.s_suppkey % 3), 0)::DOUBLE, 8) AS y
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey AND c_custkey < 100 LEFT JOIN supplier s ON s_suppkey = o_orderkey % 120 AND s_suppkey < 50""")


def _svd_all(spark, sf_dir):
    t = tables(spark, sf_dir)
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_suppkey")
    side = lambda df, key: df.select(F.col(key).alias("id"), (F.col(key) / 100).alias("bias"), F.array((F.col(key) % 7).cast("double"), (F.col(key) % 3).cast("double")).alias("factors"))
    return k.svd_score(pairs, side(t.customer, "c_custkey"), side(t.supplier, "s_suppkey"), "o_custkey", "l_suppkey", "y").select("l_orderkey", "l_linenumber", F.round("y", 8).alias("y"))


#: As ml_svd, with factors for every customer and supplier.
QUERIES["ml_svd_all"] = (_svd_all, """SELECT l_orderkey, l_linenumber, round(coalesce(c.c_custkey / 100 + s.s_suppkey / 100 + (c.c_custkey % 7) * (s.s_suppkey % 7) + (c.c_custkey % 3) * (s.s_suppkey % 3), 0)::DOUBLE, 8) AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN supplier s ON s_suppkey = l_suppkey""")




QUERIES["ml_rag_nearest"] = (
    lambda spark, sf_dir: retrieval.nearest(
        tables(spark, sf_dir).embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")),
        tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "query_id", "v", "vec_id", 3).select("query_id", "vec_id", "place"),
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT q.vec_id AS query_id, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, d.v), 6), d.vec_id) AS place FROM e q, e d WHERE q.vec_id % 50 = 0 QUALIFY place <= 3""",
)
QUERIES["ml_tokenizer"] = (lambda spark, sf_dir: tables(spark, sf_dir).documents.select("doc_id", F.size(retrieval.hash_tokenizer(F.col("text"))).alias("n")), r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))::INTEGER AS n FROM documents")

# Plans: each rule alone must give what the plan as written gives ------------------------------------------------------
_RULE_SQL = "SELECT vec_id, " + "[" + ", ".join("round(greatest(list_dot_product(v, [" + ", ".join(f"{x!r}::DOUBLE" for x in c.tolist()) + "]) + 0.1, 0), 6)" for c in _WS.T) + "] AS y FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _network_plan(spark, sf_dir):
    e = tables(spark, sf_dir).embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    names = spark.createDataFrame([(i, f"label{i}") for i in range(10)], "lid int, name string")
    joined = Join(Source("e", e, 500, {"v": 64}), Source("names", names, 10), "label", "lid")
    calls = (Call("m", models.MatMul(_WS), ("v",)), Call("b", models.Bias(np.full(6, 0.1)), ("m",)), Call("y", models.Relu(), ("b",)))
    return Project(joined, calls, keep=("vec_id", "y"))


def _after(*rules):
    def build(spark, sf_dir):
        plan = _network_plan(spark, sf_dir)
        for name in rules:
            plan = next(iter(RULES[name](plan)))
        return plan.lower().select("vec_id", F.transform("y", lambda x: F.round(x, 6) + 0.0).alias("y"))

    return build


for _name, _rules in {"as_written": (), "push_down": ("push_down",), "product_to_join": ("product_to_join",), "join_to_product": ("product_to_join", "join_to_product"), "product_to_columns": ("product_to_columns",), "fuse_layers": ("fuse_layers", "fuse_layers"), "split_layers": ("fuse_layers", "fuse_layers", "split_layers"), "dense_to_sparse": ("dense_to_sparse",)}.items():
    QUERIES[f"rule_{_name}"] = (_after(*_rules), _RULE_SQL)


def _two_tower(mode):
    def build(spark, sf_dir):
        t = tables(spark, sf_dir)
        rated = recommendation.ratings(t.orders, t.lineitem)
        plan = recommendation.two_tower_plan(rated, t.customer, t.part)
        plan = next(iter(RULES["factorise"](plan))) if mode == "factorise" else optimise(plan, mode)
        return plan.lower().select(F.col("u").alias("user_id"), F.col("i").alias("item_id"), F.round(F.element_at("score", 1), 6).alias("score"))

    return build


def _tower_sql() -> str:
    w1, w2 = recommendation.weights(15, 16, 1), recommendation.weights(16, 1, 2)
    hidden = " + ".join(f"greatest(list_dot_product(x, [{', '.join(f'{a!r}::DOUBLE' for a in w1[:, j].tolist())}]) + {float(np.linspace(-0.1, 0.1, 16)[j])!r}, 0) * {float(w2[j, 0])!r}" for j in range(16))
    hot = lambda c, names: ", ".join(f"CASE WHEN {c} = '{n}' THEN 1.0 ELSE 0.0 END" for n in names)
    return f"""WITH rated AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT user_id, item_id, [c_acctbal / 10000, c_nationkey / 25.0, {hot("c_mktsegment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}, p_size / 50.0, p_retailprice / 2000, {hot("p_type", ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))}]::DOUBLE[] AS x
  FROM rated JOIN customer ON user_id = c_custkey JOIN part ON item_id = p_partkey)
SELECT user_id, item_id, round(1 / (1 + exp(-({hidden}))), 6) AS score FROM f"""


for _mode in ("none", "factorise", "tree", "heuristic"):
    QUERIES[f"wl_two_tower_{_mode}"] = (_two_tower(_mode), _tower_sql())


def _fraud(mode):
    def build(spark, sf_dir):
        t = tables(spark, sf_dir)
        plan = fraud.plan(t.orders, t.customer)
        plan = next(iter(RULES["forest_to_relation"](plan))) if mode == "relation" else optimise(plan, mode)
        return plan.lower().select("transaction_id", F.element_at("fraud", 1).cast("int").alias("fraud"))

    return build


def _fraud_sql() -> str:
    def leaf(t, i=0):
        return repr(float(t.leaf[i])) if t.feature[i] < 0 else f"CASE WHEN x[{t.feature[i] + 1}] < {float(t.cut[i])!r} THEN {leaf(t, t.left[i])} ELSE {leaf(t, t.right[i])} END"

    votes = " + ".join(leaf(t) for t in fraud.forest().trees)
    return f"""WITH f AS (SELECT o_orderkey AS transaction_id, [o_totalprice / 500000, CASE WHEN isodow(o_orderdate) < 6 THEN 1 ELSE 0 END, day(o_orderdate) / 31, month(o_orderdate) / 12, hour(o_orderdate) / 24,
  c_custkey % 4, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END, (2002 - (1940 + c_custkey % 60)) / 100, c_nationkey]::DOUBLE[] AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT transaction_id, CASE WHEN {votes} > 0 THEN 1 ELSE 0 END AS fraud FROM f"""


for _mode in ("none", "relation", "tree"):
    QUERIES[f"wl_fraud_{_mode}"] = (_fraud(_mode), _fraud_sql())
QUERIES["wl_user_average"] = (
    lambda spark, sf_dir: recommendation.averages(recommendation.ratings(tables(spark, sf_dir).orders, tables(spark, sf_dir).lineitem), "user_id"),
    "SELECT user_id, round(avg(rating), 6) AS average, count(*) AS n FROM (SELECT o_custkey AS user_id, l_partkey, least(floor(avg(l_quantity) / 10) + 1, 5) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY user_id",
)
QUERIES["stream_tumbling_batch"] = (
    lambda spark, sf_dir: streaming.windowed_counts(tables(spark, sf_dir).events, "ts", "1 hour", ["event_type"]).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total")),
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
QUERIES["stream_sessions_batch"] = (
    lambda spark, sf_dir: streaming.sessions(tables(spark, sf_dir).events, "ts", "30 minutes", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
    """WITH m AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR ts = lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM m), c AS (SELECT user_id, seg, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
)
