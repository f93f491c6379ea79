"""Exact positions and medians: same result as a plain sort, whatever the partitioning and the skew."""

import statistics

import pytest
from pyspark.sql import functions as F

from centrum.functions.columns import row_hash, whole_div
from centrum.operators import ordering as o


def skewed(spark, n=3000, parts=4):
    """Half of the rows sit in group 0."""
    g = F.when(F.col("id") % 2 == 0, 0).otherwise((F.col("id") % 5) + 1)
    return spark.range(n).select(g.alias("g"), F.concat(F.lit("k"), F.col("id")).alias("key"), ((F.col("id") * 37) % 101).alias("v")).repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_hash_position_is_a_dense_rank_in_hash_order(spark, parts):
    df = o.hash_position(skewed(spark, parts=parts), ["g"], "key", 7).withColumn("h", row_hash("key", 7))
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((r["pos"], r["h"], r["key"], r["n_group"]))
    assert len(groups) == 6
    for rows in groups.values():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(1, len(rows) + 1))
        assert [(h, k) for _, h, k, _ in rows] == sorted((h, k) for _, h, k, _ in rows)
        assert {n for *_, n in rows} == {len(rows)}


def test_positions_do_not_depend_on_the_bucket_count(spark):
    df = skewed(spark)
    first = {(r["key"], r["pos"]) for r in o.hash_position(df, ["g"], "key", 1).collect()}
    coarse = df.withColumn("_h", row_hash("key", 1))
    second = o.ordered_position(coarse, ["g"], whole_div(F.col("_h"), 2**30), ["_h", "key"])
    assert first == {(r["key"], r["pos"]) for r in second.collect()}


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "g int, key string")
    assert sorted((r["g"] or 0, r["pos"]) for r in o.hash_position(df, ["g"], "key", 1).collect()) == [(0, 1), (0, 2), (1, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001, 6000])
def test_exact_median(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1009).cast("double").alias("v")).repartition(5)
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append(r["v"])
    got = {r["g"]: r["median"] for r in o.exact_median(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(v) for g, v in want.items()}


def test_exact_median_of_one_heavy_value_and_nulls(spark):
    df = spark.createDataFrame([(5.0,)] * 500 + [(float(i),) for i in range(100)] + [(None,)] * 30, "v double")
    assert o.exact_median(df, [], "v").first()["median"] == 5.0


def test_join_params_gives_the_same_rows_with_and_without_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    params = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("p"))
    small = o.join_params(rows, params, "k")
    large = o.join_params(rows, params, "k", max_rows=10)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert "Broadcast" in small._jdf.queryExecution().sparkPlan().toString()


def test_settle_checkpoints_large_tables(spark):
    params = spark.range(200).withColumn("x", F.rand(1))
    kept = o.settle(params, max_rows=10)
    assert kept.count() == 200 and "RDD" in kept._jdf.queryExecution().logical().toString()


def test_interval_join_finds_exactly_one_slice(spark):
    rows = spark.range(20000).select(F.lit("a").alias("c"), F.col("id").alias("r"), F.lit(20000).cast("bigint").alias("n"))
    cuts = [0, 1, 1, 4096, 12000, 20000]
    slices = spark.createDataFrame([("a", i, cuts[i], cuts[i + 1], 20000) for i in range(5)], "c string, s int, lo bigint, hi bigint, m bigint")
    got = o.interval_join(rows, slices, ["c"], "r", "n", "m").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {0: 1, 2: 4095, 3: 7904, 4: 8000}


def test_no_global_window_over_rows(spark, folder):
    """A window without partition columns may only see the counted buckets, never the rows."""
    from centrum.plans import views as V

    df = o.hash_position(V.planted_rows(spark, folder).select("row_key"), [], "row_key", 42)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [row_number()" in line:
            assert "_bucket" in line


@pytest.mark.parametrize("prefix", ["", "customer#"])
def test_sorted_codes_of_a_large_table(spark, monkeypatch, prefix):
    values = spark.range(700).select((F.col("id") % 2).cast("int").alias("g"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("value"))
    small = {tuple(r) for r in o.sorted_codes(values, ["g"], "value").collect()}
    monkeypatch.setattr(o, "small_count", lambda df: False)
    assert small == {tuple(r) for r in o.sorted_codes(values, ["g"], "value").collect()}


def test_rows_are_shuffled_once_for_a_position(spark, folder):
    """Without broadcasts the window's layout is also the join's: one exchange of rows, and two of counts."""
    from centrum.plans import views as V

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = V.planted_rows(spark, folder).select("row_key", "center_id", "label")
        plan = o.hash_position(rows, ["center_id", "label"], "row_key", 42)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows_moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(rows_moved) <= 4 and "SortMergeJoin" in plan
