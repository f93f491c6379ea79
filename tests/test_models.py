"""Learning on planted labels, and invariants of merging."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from centrum.operators import dropout, linear, merge, metrics as met, trees as tr
from centrum.operators.splits import one_pass_train_val_test
from centrum.plans import rounds, views as V


@pytest.fixture(scope="module")
def easy(spark, folder):
    return one_pass_train_val_test(V.planted_features(spark, folder), "row_key").persist()


@pytest.fixture(scope="module")
def hard(spark, folder):
    return one_pass_train_val_test(V.planted_features(spark, folder, "label2"), "row_key").persist()


def area(scored):
    return {r["center_id"]: r["auroc"] for r in met.auroc(scored, ["center_id"]).collect()}


def test_federated_logistic_learns(easy):
    train, test = easy.where("split = 'train'"), easy.where("split = 'test'")
    shared, _ = rounds.train_linear(train, 4, num_rounds=6, rate=3.0)
    alone = rounds.local_linear(train, 4, steps=6, rate=3.0)
    fed, loc = area(linear.score_linear(test, shared, 4)), area(linear.score_linear(test, alone, 4))
    assert min(fed.values()) > 0.9
    assert np.mean(list(fed.values())) >= np.mean(list(loc.values())) - 0.05


@pytest.mark.parametrize("algorithm", ["lsvc", "elastic_net"])
def test_other_linear_models_learn(easy, algorithm):
    train, test = easy.where("split = 'train'"), easy.where("split = 'test'")
    shared, _ = rounds.train_linear(train, 4, algorithm=algorithm, num_rounds=3, rate=2.0, steps=2, mu=0.02, smoothing="EqualVoting")
    scored = met.squash_margin(linear.score_linear(test, shared, 4, probability=False))
    assert min(area(scored).values()) > 0.85


def test_boosting_learns_an_interaction(hard):
    train, test = hard.where("split = 'train'"), hard.where("split = 'test'")
    grown = rounds.train_boosted(train, 4, num_rounds=3, depth=2, rate=0.5, cut_every=2)
    assert min(area(tr.score_boosted(test, grown)).values()) > 0.95
    assert grown.select("round", "center_id", "tree_id").distinct().count() == 30
    alone = rounds.train_boosted(train, 4, num_rounds=2, depth=2, rate=0.5, merged=False)
    assert min(area(tr.score_boosted(test, alone, own_center=True)).values()) > 0.95


def test_symmetric_trees_share_one_split_per_level(hard):
    grown = rounds.train_boosted(hard.where("split = 'train'"), 4, num_rounds=1, depth=2, symmetric=True).collect()
    for c in {r["center_id"] for r in grown}:
        level = {(r["feature"], r["threshold"]) for r in grown if r["center_id"] == c and r["node_id"] in (1, 2)}
        assert len(level) == 1
        assert sum(r["left"] < 0 for r in grown if r["center_id"] == c) == 4


def test_wide_gradients_equal_the_narrow_ones(easy, monkeypatch):
    rows = linear.balanced(easy.where("split = 'train'"))
    model = linear.one_model(easy.sparkSession, [0.3, -0.1, 0.2, 0.0], 0.1)
    narrow = {r["center_id"]: r["grad"] for r in linear.gradient_sums(rows, model, 4, "log").collect()}
    monkeypatch.setattr(linear, "WIDE", 2)
    wide = {r["center_id"]: r["grad"] for r in linear.gradient_sums(rows, model, 4, "log").collect()}
    assert narrow.keys() == wide.keys()
    for c in narrow:
        assert wide[c] == pytest.approx(narrow[c], rel=1e-9, abs=1e-9)


def test_gradients_against_numpy(easy):
    rows = easy.where("split = 'val'")
    model = linear.one_model(easy.sparkSession, [0.3, -0.1, 0.2, 0.5], 0.1)
    for loss in ("log", "hinge", "squared"):
        got = {r["center_id"]: r["grad"] for r in linear.gradient_sums(rows, model, 4, loss).collect()}
        local = rows.collect()
        for c in (0, 5):
            x = np.array([r["features"] for r in local if r["center_id"] == c])
            y = np.array([r["label"] for r in local if r["center_id"] == c])
            m = x @ np.array([0.3, -0.1, 0.2, 0.5]) + 0.1
            side = 2 * y - 1
            slope = {"log": 1 / (1 + np.exp(-m)) - y, "hinge": np.where(side * m < 1, -side, 0), "squared": m - y}[loss]
            assert got[c] == pytest.approx([*(slope @ x), slope.sum()], rel=1e-9)


def test_merges_agree(spark):
    models = spark.createDataFrame(
        [(0, [1.0, 2.0], 0.5, 10), (1, [3.0, -2.0], 1.5, 30)], "center_id int, coef array<double>, intercept double, n_rows bigint"
    )
    for smoothing in (None, "EqualVoting", "SlowerQuartile", "SsupperQuartile"):
        a, b = merge.merge_linear(models, smoothing).first(), merge.merge_linear(models, smoothing, width=2).first()
        assert list(a["coef"]) == pytest.approx(list(b["coef"])) and a["intercept"] == pytest.approx(b["intercept"])
    assert list(merge.merge_linear(models, width=2).first()["coef"]) == [2.5, -1.0]
    for m in (None, "EqualVoting", "SlowerQuartile", "x"):
        assert merge.smoothed_weights(models, m).agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def two_stumps(spark):
    rows = [
        (1, 0, 1, 0, 0, 5.0, 1, 2, 0.0, 4.0, 1.0), (1, 0, 1, 1, -1, None, -1, -1, -1.0, 2.0, 1.0), (1, 0, 1, 2, -1, None, -1, -1, 1.0, 2.0, 1.0),
        (1, 1, 1, 0, 1, 0.0, 1, 2, 0.0, 4.0, 1.0), (1, 1, 1, 1, -1, None, -1, -1, 0.25, 2.0, 1.0), (1, 1, 1, 2, -1, None, -1, -1, 0.5, 2.0, 1.0),
    ]
    return spark.createDataFrame(rows, tr.TREES)


def test_two_stumps(spark, monkeypatch):
    trees = two_stumps(spark)
    rows = spark.createDataFrame([(0, [4.0, 1.0]), (1, [5.0, -1.0])], "center_id int, features array<double>")
    encoded = {r["center_id"]: r["tree_out"] for r in tr.encode_trees(rows, trees).collect()}
    assert encoded == {0: [-1.0, 0.5], 1: [1.0, 0.25]}
    margins = {r["center_id"]: r["margin"] for r in tr.add_margin(rows, trees).collect()}
    assert margins == {0: -0.5, 1: 1.25}
    own = {r["center_id"]: r["margin"] for r in tr.add_margin(rows, trees, own_center=True).collect()}
    assert own == {0: -1.0, 1: 0.25}
    monkeypatch.setattr(tr, "NODES_PER_PASS", 3)
    chunked = {r["center_id"]: r["tree_out"] for r in tr.encode_trees(rows, trees).collect()}
    assert chunked == encoded
    assert {r["score"] for r in tr.score_forest(rows, trees).collect()} == {-0.25, 0.625}


def test_bagging_keeps_all_trees(spark):
    first = merge.bagging_merge(None, two_stumps(spark), 1)
    both = merge.bagging_merge(first, two_stumps(spark), 2)
    assert sorted(r["tree_id"] for r in both.select("tree_id").distinct().collect()) == [0, 1, 2, 3]
    assert both.count() == 12
    rates = merge.step_sizes(spark.createDataFrame([(0, 1), (1, 3)], "center_id int, n_rows bigint"), 0.2, "weighted")
    assert {r["center_id"]: r["rate"] for r in rates.collect()} == pytest.approx({0: 0.05, 1: 0.15})


def test_forest_draws(spark):
    index = spark.createDataFrame([(c, t) for c in range(3) for t in range(9)], "center_id int, tree_id int")
    drawn = merge.forest_random_draw(index)
    assert {r["center_id"]: r["count"] for r in drawn.groupBy("center_id").count().collect()} == {0: 3, 1: 3, 2: 3}
    weights = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.75)], "center_id int, weight double")
    n = {r["center_id"]: r["count"] for r in merge.forest_weighted_draw(index, weights, 4000).groupBy("center_id").count().collect()}
    assert sum(n.values()) == 4000 and 0 not in n and n[2] / 4000 == pytest.approx(0.75, abs=0.03)


def test_dropout_keeps_the_right_number(spark):
    stats = spark.createDataFrame([(i, 10 + i, float(100 - i)) for i in range(10)], "center_id int, n_rows bigint, cost double")
    for method in ("Fast_at_odd_rounds", "Fast_every_three", "random_dropout", "anything"):
        for r in (2, 3, 4):
            assert dropout.choose_centers(method, stats, 35.0, r).count() == 6
    assert dropout.choose_centers("random_dropout", stats, 35.0, 1).count() == 10
    assert {r["center_id"] for r in dropout.choose_centers("Fast_at_odd_rounds", stats, 80.0, 2).collect()} == {8, 9}
    assert {r["center_id"] for r in dropout.choose_centers("Fast_at_odd_rounds", stats, 80.0, 3).collect()} == {0, 1}


def test_one_vs_rest(spark, folder):
    rows = V.planted_features(spark, folder).withColumn("label", F.floor(F.col("features")[0] * 2.99).cast("double"))
    ensembles = rounds.one_vs_rest(rows, 4, [0.0, 1.0, 2.0], num_rounds=1, depth=2)
    out = met.multiclass_accuracy(rounds.predict_one_vs_rest(rows, ensembles, [0.0, 1.0, 2.0]).withColumn("center_id", F.lit(0)), ["center_id"])
    assert out.first()["accuracy"] > 0.9


def test_tree_encoded_head(hard):
    encoded, trees, width = rounds.encoded_rows(hard, 4, trees_per_center=1, depth=2)
    assert width == 10
    train, test = encoded.where("split = 'train'"), encoded.where("split = 'test'")
    shared, _ = rounds.train_linear(train, width, num_rounds=2, rate=5.0)
    assert min(area(linear.score_linear(test, shared, width)).values()) > 0.9


def test_settings_are_checked():
    for bad in [dict(num_rounds=0), dict(num_rounds=1, smoothing="x"), dict(num_rounds=1, smoothing="EqualVoting", strength=2.0), dict(num_rounds=1, dropout_method="a", percent=100.0)]:
        with pytest.raises(ValueError):
            rounds.check_settings(**bad)


def test_a_center_without_split_gets_a_leaf(spark):
    rows = [(0, [float(i)], -0.5 if i < 5 else 0.5, 0.25) for i in range(10)] + [(1, [1.0], -0.5, 0.25)] * 4
    df = spark.createDataFrame(rows, "center_id int, features array<double>, g double, h double")
    edges = tr.bin_edges(df, 1)
    grown = tr.grow(tr.with_bins(df, edges, 1, 4), edges, 1, 1, 4).where("center_id = 1").collect()
    assert [(r["node_id"], r["left"], round(r["value"], 9)) for r in grown] == [(0, -1, round(0.3 * 2.0 / 2.0, 9))]


def test_local_training_ends_when_it_has_converged(easy):
    weighted = linear.balanced(easy.where("split = 'train'")).persist()
    start = linear.shared_start(weighted, 4)
    many = linear.local_round(weighted, start, 4, rate=1.0, steps=12, tolerance=10.0)
    two = linear.local_round(weighted, start, 4, rate=1.0, steps=2)
    assert {r["center_id"]: r["coef"] for r in many.collect()} == {r["center_id"]: r["coef"] for r in two.collect()}
    weighted.unpersist()
