"""Loops that go on after a stop, running sums in ranges, the area under crowded scores."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from centrum.operators import merge, metrics as met
from centrum.operators.ordering import running_sums
from centrum.plans import rounds, views as V
from centrum.sources import sinks


@pytest.fixture(scope="module")
def planted(spark, folder):
    return V.planted_features(spark, folder, "label2").select("row_key", "center_id", "features", "label").persist()


def nodes(trees):
    return [
        (r["round"], r["center_id"], r["tree_id"], r["node_id"], r["feature"], r["threshold"], pytest.approx(r["value"], abs=1e-9))
        for r in trees.orderBy("round", "center_id", "tree_id", "node_id").collect()
    ]


def stop_after(loop, last):
    for item in loop:
        if item[0] == last:
            loop.close()
            return


@pytest.mark.parametrize("settings", [{}])
def test_boosting_goes_on_after_a_stop(planted, tmp_path, settings):
    path, common = str(tmp_path / "s"), {"depth": 2, "rate": 0.5, **settings}
    whole = rounds.train_boosted(planted, V.WIDTH, num_rounds=4, **common)
    stop_after(rounds.boosted_rounds(planted, V.WIDTH, num_rounds=4, store=path, **common), 2)
    rest = list(rounds.boosted_rounds(planted, V.WIDTH, num_rounds=4, store=path, **common))
    assert [r for r, _ in rest] == [3, 4]
    assert nodes(rest[-1][1]) == nodes(whole)
    again = list(rounds.boosted_rounds(planted, V.WIDTH, num_rounds=4, store=path, **common))
    assert [r for r, _ in again] == [4] and nodes(again[0][1]) == nodes(whole)
    with pytest.raises(ValueError):
        next(rounds.boosted_rounds(planted, V.WIDTH, num_rounds=4, store=path, **{**common, "rate": 0.4}))


def test_linear_rounds_go_on_after_a_stop(planted, tmp_path):
    path = str(tmp_path / "s")
    whole, own = rounds.train_linear(planted, V.WIDTH, num_rounds=4)
    stop_after(rounds.linear_rounds(planted, V.WIDTH, num_rounds=4, store=path), 2)
    rest = list(rounds.linear_rounds(planted, V.WIDTH, num_rounds=4, store=path))
    again = list(rounds.linear_rounds(planted, V.WIDTH, num_rounds=4, store=path))
    assert [r for r, *_ in rest] == [3, 4] and [r for r, *_ in again] == [4]
    for _, shared, models in (rest[-1], again[0]):
        assert shared.first()["coef"] == pytest.approx(whole.first()["coef"], abs=1e-9)
        got = {r["center_id"]: r["coef"] for r in models.collect()}
        assert got == {r["center_id"]: pytest.approx(r["coef"], abs=1e-9) for r in own.collect()}


def test_a_round_without_a_note_does_not_count(spark, tmp_path):
    store = sinks.RoundStore(spark, str(tmp_path / "s"), {"a": 1})
    assert store.last() == 0
    store.commit(spark.range(3), 1)
    spark.range(9).write.parquet(str(tmp_path / "s" / "rows" / "step=2"))
    assert store.last() == 1 and store.upto(1).count() == 3
    store.commit(spark.range(5), 2)
    assert store.last() == 2 and store.step(2).count() == 5


def test_running_sums(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("k"), (F.col("id") % 13 / 7).alias("v"))
        out = running_sums(rows, ["k"], total=F.col("v"), place=F.lit(1))
        got = out.orderBy("k").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["place"].tolist() == list(range(1, 3001)) and got["place_before"].tolist() == list(range(3000))
    assert (got["total"] - got["v"].cumsum()).abs().max() < 1e-9
    assert got["total_before"].tolist()[1:] == got["total"].tolist()[:-1]
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert running_sums(rows.where("false"), ["k"], place=F.lit(1)).count() == 0


def test_renumbered_trees_follow_the_order(spark):
    index = spark.createDataFrame([(c, t) for c in (2, 0, 1) for t in range(40)], "center_id int, tree_id int")
    got = merge.renumber(index, ["center_id", "tree_id"], 5).orderBy("center_id", "tree_id").collect()
    assert [r["new_id"] for r in got] == list(range(5, 125))


def test_area_of_crowded_scores(spark):
    draw = random.Random(7)
    values = [0.5 + draw.randrange(400) * 1e-15 for _ in range(700)] + [draw.choice([0.0, -1.5, 2.0, 1.0, 1e-300]) for _ in range(200)]
    rows = [(i % 2, v, float(draw.random() < 0.4)) for i, v in enumerate(values)]
    got = met.auroc(spark.createDataFrame(rows, "center_id int, score double, label double"), ["center_id"]).collect()
    for r in got:
        part = pd.DataFrame([x for x in rows if x[0] == r["center_id"]], columns=["c", "s", "y"])
        p, n = (part["y"] == 1).sum(), (part["y"] == 0).sum()
        want = (part["s"].rank()[part["y"] == 1].sum() - p * (p + 1) / 2) / (p * n)
        assert r["auroc"] == pytest.approx(want, abs=1e-12)


def test_score_buckets_never_fall_and_stay_small(spark):
    values = [0.0, 5e-324, 1e-300, 1e300, float("inf")]
    for k in (-1000, -53, -10, -2, -1, 0, 1, 7, 60):
        for v in (math.nextafter(2.0**k, 0), 2.0**k, math.nextafter(2.0**k, 9e99), 1.3 * 2.0**k):
            values += [v, -v]
    values = sorted(set(values))
    frame = spark.createDataFrame([(v,) for v in values], "score double").select("score", met.score_bucket(F.col("score")).alias("b"))
    got = [r["b"] for r in frame.orderBy("score").collect()]
    assert got == sorted(got) and len(set(got)) > len(values) / 2
