"""Operators whose errors, nulls or plans a query can't show; sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom import sources, streaming


def test_single_row(spark):
    with pytest.raises(Exception, match="single row"):
        op.enforce_single_row(spark.range(3)).collect()
    assert op.enforce_single_row(spark.range(0)).collect()[0].id is None


def test_unnest_pads_with_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a"]), (2, None, None), (3, [], ["x", "y"])], "k int, a array<int>, b array<string>")
    rows = [(r.k, r.a_e, r.b_e, r.at) for r in op.unnest(df, ["k"], ["a", "b"], "at").collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, "a", 1), (1, 2, None, 2), (3, None, "x", 1), (3, None, "y", 2)], key=str)


@pytest.mark.parametrize(("right", "want"), [([], {1: False, 2: False, None: False}), ([1], {1: True, 2: False, None: None}), ([1, None], {1: True, 2: None, None: None})])
def test_null_aware_semi_project(spark, right, want):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    other = spark.createDataFrame([(x,) for x in right], "b int")
    assert {r.a: r.m for r in op.semi_project(left, other, "a", "b", "m", null_aware=True).collect()} == want
    anti = {r.a for r in op.anti_join(left, other, "a", "b", null_aware=True).collect()}
    assert anti == {k for k, v in want.items() if v is False}


def test_column_offsets_and_tiles(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None, 2) for i in range(7)], "i int, o int, n int").withColumn("p", F.lit(1))
    rows = {r.i: r.v for r in op.shift_by(df, "i", "o", ["p"], ["i"], "v", F.lit(-1)).collect()}
    assert rows == {0: None, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    assert [r.t for r in op.ntile_by(df, "n", ["p"], ["i"], "t").orderBy("i").collect()] == [1, 1, 1, 1, 2, 2, 2]
    with pytest.raises(Exception, match="positive"):
        op.ntile_by(df.withColumn("n", F.lit(0)), "n", ["p"], ["i"], "t").collect()


def test_scan_pushes_filters_and_prunes_columns(spark, small):
    plan = sources.scan(spark, f"{small}/lineitem.parquet", ["l_orderkey"], ["l_quantity > 45"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_top_n_is_not_a_full_sort(spark, small):
    plan = op.top_n(spark.read.parquet(f"{small}/part.parquet"), 5, "p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_group_limit_comes_before_the_shuffle(spark, small):
    df = op.top_n_row_number(spark.read.parquet(f"{small}/orders.parquet"), ["o_custkey"], ["o_orderkey"], 2)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_formats_and_modes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for kind in ("parquet", "orc", "json"):
        path = str(tmp_path / kind)
        sources.write(df, path, kind=kind, compression="zstd" if kind != "json" else "gzip")
        assert sorted((r.k, r.s) for r in sources.scan(spark, path, kind=kind).collect()) == [(1, "a"), (2, None)]
        with pytest.raises(Exception):  # noqa: B017
            sources.write(df, path, kind=kind)
        assert sources.write(df, path, kind=kind, mode="append").first()["rows"] == 4
    with pytest.raises(ValueError):
        sources.scan(spark, "x", kind="dwrf")
    assert sources.scan(spark, str(tmp_path / "orc"), ["k"], kind="orc", file_column="f").filter("f LIKE '%orc%'").count() == 4
    assert len(list(sources.deliver(df))) == 2


def test_stream_agrees_with_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), ", ".join(f"{c} {t}" for c, t in events.dtypes), 1)
    query = streaming.windowed_counts(stream, "ts", "1 day", ["event_type"], late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("counts").collect())
    assert got == sorted((r.start, r.event_type, r.n) for r in streaming.windowed_counts(events, "ts", "1 day", ["event_type"]).collect())


def test_stream_drops_repeats(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.union(events).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), ", ".join(f"{c} {t}" for c, t in events.dtypes), 2)
    query = streaming.deduplicate(stream, "ts", ["event_id"], "60 days").writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == events.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_by_orders_all_rows_without_one_task_for_them(spark, small):
    from gridloom import queries as registry

    df = registry.queries()["rel_order_by"](spark, small)
    rows = [(r.a, r.c_custkey) for r in df.collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert "rangepartitioning" in plan_of(df) and "SinglePartition" not in plan_of(df)


def test_partitionings_have_the_plans_that_they_say(spark, small):
    from gridloom import queries as registry

    dealt = plan_of(registry.queries()["rel_partitioned_output"](spark, small))
    assert dealt.count("Exchange hashpartitioning(s_nationkey") == 1  # the grouping uses the partitions that there are
    local = plan_of(registry.queries()["rel_local_partition"](spark, small))
    assert "RoundRobinPartitioning(6)" in local and "Coalesce 3" in local
    ranged = plan_of(op.repartition(spark.range(10), "range", 3, "id"))
    assert "rangepartitioning(id" in ranged
    merged = plan_of(registry.queries()["rel_merge_exchange_all"](spark, small))
    assert "rangepartitioning" in merged and "Union" in merged
