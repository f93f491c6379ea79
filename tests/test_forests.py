"""Forests against a plain recursion, and cut points against exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from centrum.functions.columns import row_hash
from centrum.operators import binning, forests as fo, metrics as met, ordering as o, splits as sp, trees as tr
from centrum.operators.splits import one_pass_train_val_test
from centrum.plans import rounds, views as V

ROWS = "row_key string, center_id int, features array<double>, label double"


@pytest.fixture(scope="module")
def few(spark, folder):
    rows = V.planted_features(spark, folder, "label2").where("center_id < 3")
    return rows.unionByName(spark.createDataFrame([("only", 9, [1.0, 2.0, 3.0, 4.0], 1.0), ("nolabel", 1, [0.0, 0.0, 0.0, 0.0], None)], ROWS)).persist()


def plain_forest(rows, cuts, trees, depth, per_node, seed, weights, rates):
    """All nodes of one center's trees by recursion: (tree, node) -> (feature, threshold, n0, n1)."""
    out = {}
    bins = np.array([[sum(c <= v for c in cuts[f]) for f, v in enumerate(r["features"])] for r in rows])
    label, h = np.array([int(r["label"]) for r in rows]), np.array([r["h"] for r in rows], np.uint64)
    center = rows[0]["center_id"]
    for tree in range(trees):
        bag = np.array([(fo.poisson_steps(rates[y]) <= fo.mix(x, tree + 1)).sum() for x, y in zip(h, label)])

        def purity(own):
            w = [weights[y] * bag[own & (label == y)].sum() for y in (0, 1)]
            return sum(x * x for x in w) / sum(w) if sum(w) else 0.0

        def walk(own, node, level):
            counts = tuple(int(bag[own & (label == y)].sum()) for y in (0, 1))
            best = (0.0, None)
            if level < depth:
                for f in fo.node_features(center, tree, node, bins.shape[1], per_node, seed).tolist():
                    for b in range(len(cuts[f])):
                        left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                        if bag[left].sum() and bag[right].sum():
                            gain = round(purity(left) + purity(right) - purity(own), 9)
                            if gain > best[0]:
                                best = gain, (f, b)
            if best[1] is None:
                out[tree, node] = (-1, None, *counts)
                return
            f, b = best[1]
            out[tree, node] = (f, cuts[f][b], *counts)
            walk(own & (bins[:, f] <= b), 2 * node + 1, level + 1)
            walk(own & (bins[:, f] > b), 2 * node + 2, level + 1)

        if bag.sum():
            walk(np.ones(len(rows), bool), 0, 0)
    return out


@pytest.mark.parametrize("balance", [False, True])
def test_forest_equals_a_plain_recursion(few, balance):
    nodes = fo.forest_nodes(few, "row_key", 4, trees=3, depth=3, balance=balance, bins=8).collect()
    edges = {r["center_id"]: r["cuts"] for r in binning.sketch_edges(few, 4, 8).collect()}
    rows = few.where("label is not null").withColumn("h", row_hash("row_key", 42)).collect()
    for center in (0, 1, 2, 9):
        own = [r for r in rows if r["center_id"] == center]
        n = [sum(r["label"] == y for r in own) for y in (0, 1)]
        weights = [1.0, 1.0] if balance else [len(own) / (2 * c) if c else 1.0 for c in n]
        rates = [min(n) / c if balance and c else 1.0 for c in n]
        want = plain_forest(own, edges[center], 3, 3, 2, 42, weights, rates)
        got = {(r["tree_id"], r["node_id"]): (r["feature"], r["threshold"], r["n0"], r["n1"]) for r in nodes if r["center_id"] == center}
        assert got == want


def test_large_and_small_nodes_give_the_same_trees(few):
    key = lambda settings: sorted(tuple(r) for r in fo.forest_nodes(few, "row_key", 4, trees=4, depth=5, bins=16, **settings).collect())
    whole = key({})
    assert len(whole) > 100 and key({"small": 40}) == whole and key({"small": 100, "nodes_per_pass": 1}) == whole


def test_jobs_do_not_grow_with_centers(spark, folder):
    rows = V.planted_features(spark, folder, "label2")

    def jobs(df, name):
        spark.sparkContext.setJobGroup(name, name)
        fo.forest_nodes(df, "row_key", 4, trees=3, depth=3).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    many = rows.withColumn("center_id", F.pmod(F.xxhash64("row_key"), F.lit(200)).cast("int"))
    counts = jobs(rows.where("center_id < 2"), "two centers"), jobs(many, "200 centers")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts[1] <= counts[0]


def test_forest_learns_and_reports_importances(spark, folder):
    rows = one_pass_train_val_test(V.planted_features(spark, folder, "label2"), "row_key").persist()
    nodes = fo.forest_nodes(rows.where("split = 'train'"), "row_key", 4, trees=20, depth=6)
    trees = fo.forest_round(rows.where("split = 'train'"), "row_key", 20, 6)
    area = {r["center_id"]: r["auroc"] for r in met.auroc(tr.score_forest(rows.where("split = 'test'"), trees, own_center=True), ["center_id"]).collect()}
    assert len(area) == 10 and min(area.values()) > 0.9
    share = {(r["center_id"], r["feature"]): r["score"] for r in fo.importances(nodes, ["quantity", "price", "discount", "tax"]).collect()}
    assert all(abs(sum(v for (c, _), v in share.items() if c == k) - 1) < 1e-9 for k in range(10))
    assert all(share[k, "quantity"] + share[k, "discount"] > 0.7 for k in range(10))
    rows.unpersist()


def test_forest_of_odd_rows(spark):
    rows = [(f"{i}", i % 2, [float(i % 7), None if i % 5 else 1.0, float("nan")], float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], ROWS)
    nodes = fo.forest_nodes(df, "row_key", 3, trees=5, depth=4)
    assert nodes.where("node_id = 0").count() == 10 and nodes.where("feature = 2").count() == 0
    assert fo.forest_nodes(df.where("false"), "row_key", 3, trees=5, depth=4).collect() == []
    with pytest.raises(ValueError):
        fo.forest_nodes(df, "row_key", 3, depth=0)


def skewed(spark, n=20_000):
    x = F.col("id")
    value = F.when(x == 7, 1e9).when(x % 3 == 0, 5.0).otherwise((x % 5000) ** 2 / 1000.0)
    return spark.range(n).select((x % 2).cast("int").alias("center_id"), F.array(value, (x % 6).cast("double"), F.when(x % 2 == 0, x * 1.0)).alias("features"), F.when(x % 10 == 0, 9.0).otherwise(1.0).alias("h"))


@pytest.mark.parametrize("weight", [None, "h"])
def test_cuts_hold_equal_parts_of_skewed_values(spark, weight):
    df = skewed(spark)
    cuts = {r["center_id"]: r["cuts"] for r in binning.sketch_edges(df, 3, 16, weight).collect()}
    rows = df.collect()
    for center in (0, 1):
        own = [(r["features"][0], r["h"] if weight else 1.0) for r in rows if r["center_id"] == center]
        values, mass = np.array([v for v, _ in own]), np.array([w for _, w in own])
        bins = np.searchsorted(cuts[center][0], values, "right")
        share = np.bincount(bins, mass, 17) / mass.sum()
        heavy = mass[values == 5.0].sum() / mass.sum()
        assert share.max() <= heavy + 2 / 16 and np.sort(share)[::-1][1] <= 1 / 16 + 0.02 and max(cuts[center][0]) < 1e6
        assert cuts[center][1] == sorted({r["features"][1] for r in rows if r["center_id"] == center})[1:]
    assert cuts[1][2] == [] and len(cuts[0][2]) == 15


def test_cuts_of_nothing(spark):
    df = spark.createDataFrame([(1, [None]), (2, [float("nan")]), (3, [4.0])], "center_id int, features array<double>")
    assert sorted(tuple(r) for r in binning.sketch_edges(df, 1, 4).collect()) == [(1, [[]]), (2, [[]]), (3, [[]])]
    assert binning.sketch_edges(df.where("false"), 1, 4).collect() == []
    assert binning.with_cut_bins(df, binning.sketch_edges(df, 1, 4), 1).where("bins[0] = 0").count() == 3


def test_several_trees_a_round_learn(few):
    rows = few.where("label is not null and center_id < 3")
    grown = rounds.train_boosted(rows, 4, num_rounds=3, depth=2, rate=0.5, parallel=2, subsample=0.7, key="row_key")
    ids = {(r["round"], r["tree_id"]) for r in grown.select("round", "tree_id").distinct().collect()}
    assert ids == {(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 6)}
    area = {r["center_id"]: r["auroc"] for r in met.auroc(tr.score_boosted(rows, grown), ["center_id"]).collect()}
    assert min(area.values()) > 0.95
    with pytest.raises(ValueError):
        rounds.train_boosted(rows, 4, parallel=2)


def test_equal_parallel_trees_are_one_tree(few):
    rows = few.where("label is not null and center_id < 3")
    one = rounds.train_boosted(rows, 4, num_rounds=1, depth=2)
    two = rounds.train_boosted(rows, 4, num_rounds=1, depth=2, parallel=2, key="row_key")
    a = {(r["center_id"], r["node_id"]): r["value"] for r in one.collect()}
    b = {}
    for r in two.collect():
        k = r["center_id"], r["node_id"]
        b[k] = b.get(k, 0.0) + r["value"]
    assert b == pytest.approx(a)


def bounds_at(*places):
    return lambda sizes: sizes.withColumn("bounds", F.array(*[F.lit(p).cast("bigint") for p in places]))


def test_slices_follow_the_hash_order(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = o.deal(df, ["g"], "key", (7,), bounds_at(0, 10, 10, 900, 10**9), "s").collect()
    ranks = {r["key"]: r["pos"] - 1 for r in o.hash_position(df, ["g"], "key", 7).collect()}
    assert len(got) == 5000 and all(r["s"] == sum(b <= ranks[r["key"]] for b in (0, 10, 10, 900)) for r in got)


def test_slices_of_nothing_and_of_equal_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", None)], "key string, g int")
    got = sorted((r["key"], r["s"]) for r in o.deal(df, ["g"], "key", (1,), bounds_at(3), "s").collect())
    assert [k for k, _ in got] == ["a"] * 5 + ["b"] and len({s for k, s in got if k == "a"}) == 1
    assert o.deal(df.where("false"), ["g"], "key", (1,), bounds_at(1), "s").collect() == []
    assert o.deal(df.where("false"), [], "key", (1,), bounds_at(1), "s").collect() == []


@pytest.mark.parametrize("split", [sp.stratified_split, sp.train_val_test, sp.one_pass_train_val_test])
def test_splits_move_no_rows(spark, folder, split):
    rows = V.planted_features(spark, folder)
    plan = split(rows, "row_key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_equal_rows_are_counted_before_they_are_sent(spark, monkeypatch):
    """What goes to the tasks that grow trees follows the cells, not the rows."""
    rows = spark.range(0, 30_000, 1, 4).select(
        F.col("id").cast("string").alias("row_key"), F.lit(0).alias("center_id"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double")).alias("features"),
        (F.col("id") % 7 < 3).cast("double").alias("label"),
    )
    sizes = []
    kept = fo.join_params

    def seen(df, *rest):
        if "cells" in df.columns:
            sizes.append(df.agg(F.sum(F.length("cells")), F.sum(F.length("bag"))).first())
        return kept(df, *rest)

    monkeypatch.setattr(fo, "join_params", seen)
    nodes = fo.forest_nodes(rows, "row_key", 2, trees=3, depth=4)
    drawn = {r["tree_id"]: r["n0"] + r["n1"] for r in nodes.where("node_id = 0").collect()}
    assert len(drawn) == 3 and all(29_000 < n < 31_000 for n in drawn.values())
    assert len(sizes) == 1 and sum(sizes[0]) < 3 * 30_000 / 4


def test_bag_counts_by_limits():
    h = np.arange(20_000, dtype=np.uint64) * 104_729 % 2**32
    rates = np.where(np.arange(len(h)) % 3 == 0, 0.25, 1.0)
    for own in (rates, np.ones(len(h)), np.zeros(len(h))):
        want = [np.searchsorted(fo.poisson_steps(r), x, "right") for r, x in zip(own.tolist(), fo.mix(h, 8).astype(np.uint64))]
        assert fo.bag_counts(h.astype(np.uint32), 7, fo.bag_limits(own)).tolist() == want
