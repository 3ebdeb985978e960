"""Fraud detection: payments joined with their customers, features of both, a forest and a network over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.ml import kernels, models
from gridloom.plans import Call, Filter, Join, Project, Source


def transactions(orders: DataFrame, top: float = 500000.0) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("sender"), F.to_date("o_orderdate").alias("t_day"), kernels.transaction_features(F.col("o_totalprice"), F.col("o_orderdate"), top).alias("t_features"))


def customers(customer: DataFrame, year: int = 2002) -> DataFrame:
    birth = F.lit(1940) + F.pmod("c_custkey", F.lit(60))
    return customer.select(F.col("c_custkey").alias("id"), kernels.customer_features(F.pmod("c_custkey", F.lit(4)), (F.col("c_acctbal") > 0).cast("int"), birth, F.col("c_nationkey"), year).alias("c_features"))


def forest(seed: int = 3, trees: int = 9) -> models.Forest:
    """Small trees over the nine features, the same for the same seed."""
    draw = np.random.default_rng(seed)
    texts = []
    for _ in range(trees):
        a, b, c = draw.integers(0, 9, 3)
        x, y, z = np.round(draw.uniform(0, 1, 3), 3)
        leaves = np.round(draw.uniform(-1, 1, 4), 3)
        texts.append(f"0:[f{a}<{x}] yes=1,no=2,missing=1\n1:[f{b}<{y}] yes=3,no=4,missing=3\n2:[f{c}<{z}] yes=5,no=6,missing=5\n" + "\n".join(f"{3 + i}:leaf={v}" for i, v in enumerate(leaves)))
    return models.Forest(tuple(map(models.Tree.parse, texts)), classification=True)


def plan(orders: DataFrame, customer: DataFrame, n_orders: float = 1e5) -> Project:
    joined = Join(Source("transactions", transactions(orders), n_orders, {"t_features": 5}), Source("customers", customers(customer), 1e3, {"c_features": 4}), "sender", "id")
    recent = Filter(joined, "t_day >= DATE'1997-01-01'", ("t_day",), 0.6)
    return Project(recent, (Call("fraud", forest(), ("t_features", "c_features")),), keep=("transaction_id", "fraud"))
