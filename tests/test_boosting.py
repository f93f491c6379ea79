"""Boosting with several classes, penalties and oblivious trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from centrum.operators import trees as tr
from centrum.plans import rounds, views as V


@pytest.fixture(scope="module")
def rows(spark, folder):
    return V.planted_features(spark, folder, "label2").where("center_id < 3").persist()


def test_classes_are_learned_together(rows):
    three = rows.withColumn("label", F.when(F.col("features")[0] < 0.3, 0.0).when(F.col("features")[2] > 0.5, 1.0).otherwise(2.0))
    trees = None
    for _, trees in rounds.class_rounds(three, 4, 3, num_rounds=3, depth=2, rate=0.5, rate_mode="uniform", cut_every=2):
        pass
    assert trees.select("round", "center_id", "class_no").distinct().count() == 27
    scored = rounds.predict_classes(three, trees, 3)
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97
    assert scored.where(F.abs(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9).isEmpty()


def test_softmax_derivatives(spark):
    df = spark.createDataFrame([(1.0, [0.0, float(np.log(2.0)), 0.0]), (0.0, [1000.0, 0.0, -1000.0])], "label double, margins array<double>")
    got = tr.softmax_gradients(df, 3).collect()
    assert got[0]["gs"] == pytest.approx([0.25, -0.5, 0.25]) and got[0]["hs"] == pytest.approx([3 / 16, 0.25, 3 / 16])
    assert got[1]["gs"] == pytest.approx([0, 0, 0]) and got[1]["hs"] == pytest.approx([0, 0, 0])


def test_a_large_penalty_leaves_only_empty_roots(rows):
    _, grown = next(rounds.boosted_rounds(rows, 4, 1, 2, merged=False, reg_alpha=1e9))
    assert {(r["node_id"], r["feature"], abs(r["value"])) for r in grown.collect()} == {(0, -1, 0.0)}


@pytest.mark.parametrize("own", [True, False])
def test_oblivious_trees_need_no_walk(rows, own):
    trees = rounds.train_boosted(rows, 4, num_rounds=2, depth=3, symmetric=True, merged=not own)
    walked = {r["row_key"]: r["m"] for r in tr.add_margin(rows, trees, "m", own_center=own).collect()}
    indexed = {r["row_key"]: r["m"] for r in tr.score_symmetric(rows, trees, "m", own_center=own).collect()}
    assert walked.keys() == indexed.keys() and all(indexed[k] == pytest.approx(walked[k], abs=1e-9) for k in walked)
    plan = tr.score_symmetric(rows, trees, "m", own_center=own)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_oblivious_scoring_of_nothing(spark, rows):
    assert tr.score_symmetric(rows, tr.no_trees(spark), "m").where("m <> 0").isEmpty()
    tree = [(1, 0, 1, 0, 0, 0.5, 1, 2, 0.0, None, None), (1, 0, 1, 1, -1, None, -1, -1, 7.0, None, 2.0), (1, 0, 1, 2, 1, 0.5, 5, 6, 0.0, None, None),
            (1, 0, 1, 5, -1, None, -1, -1, 3.0, None, 2.0), (1, 0, 1, 6, -1, None, -1, -1, 4.0, None, 2.0)]
    df = spark.createDataFrame([("a", 0, [0.1, 0.9]), ("b", 0, [0.9, 0.1]), ("c", 0, [0.9, 0.9]), ("d", 5, [0.0, 0.0])], "row_key string, center_id int, features array<double>")
    got = {r["row_key"]: r["m"] for r in tr.score_symmetric(df, spark.createDataFrame(tree, tr.TREES), "m", own_center=True).collect()}
    assert got == {"a": 14.0, "b": 6.0, "c": 8.0, "d": 0.0}
