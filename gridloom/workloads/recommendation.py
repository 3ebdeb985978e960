"""Recommendation: ratings of customers for parts, two-tower scores, factor models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.ml import kernels, models
from gridloom.plans import Call, Join, Project, Source


def ratings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(user_id, item_id, rating): a customer's mean quantity of a part, as 1 to 5."""
    bought = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    return bought.agg(F.avg("l_quantity").alias("q")).select("user_id", "item_id", F.least(F.floor(F.col("q") / 10) + 1, F.lit(5)).cast("int").alias("rating"))


def averages(rated: DataFrame, key: str) -> DataFrame:
    return rated.groupBy(key).agg(F.round(F.avg("rating"), 6).alias("average"), F.count("*").alias("n"))


def user_tower(customer: DataFrame) -> DataFrame:
    """Features of a user: balance, nation and segment."""
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0), F.transform(kernels.one_hot(F.col("c_mktsegment"), segments), lambda x: x.cast("double"))).alias("user_features"))


def item_tower(part: DataFrame) -> DataFrame:
    kinds = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    return part.select(F.col("p_partkey").alias("item_id"), F.concat(F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000), F.transform(kernels.one_hot(F.col("p_type"), kinds), lambda x: x.cast("double"))).alias("item_features"))


def weights(rows: int, columns: int, seed: int) -> np.ndarray:
    return np.round(np.random.default_rng(seed).standard_normal((rows, columns)) / np.sqrt(rows), 4)


def two_tower_plan(rated: DataFrame, customer: DataFrame, part: DataFrame, n_rated: float = 1e5) -> Project:
    """A score for each rated pair by a network over both sides' features, as a plan that the rules can rewrite."""
    users, items = user_tower(customer), item_tower(part)
    joined = Join(Join(Source("rated", rated.select(F.col("user_id").alias("u"), F.col("item_id").alias("i")), n_rated), Source("users", users, 1e3, {"user_features": 7}), "u", "user_id"), Source("items", items, 1e3, {"item_features": 8}), "i", "item_id")
    network = models.NNBuilder().dense(weights(15, 16, 1), np.linspace(-0.1, 0.1, 16)).relu().dense(weights(16, 1, 2)).sigmoid().build()
    return Project(joined, (Call("score", network, ("user_features", "item_features")),), keep=("u", "i", "score"))
