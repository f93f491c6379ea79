import pytest
from pyspark.sql import functions as F

from centrum.operators import fairness, metrics as met, results as rs
from centrum.plans import views as V


def scored(spark, rows):
    return spark.createDataFrame([(0, float(s), float(y)) for s, y in rows], "center_id int, score double, label double")


def test_single_class_center(spark):
    out = met.all_metrics(scored(spark, [(0.9, 1), (0.8, 1), (0.2, 1), (0.6, 1)]), ["center_id"]).first()
    assert out["recall"] == 0.75 and out["specificity"] == 0.0 and out["auroc"] == 0.0 and out["precision"] == 1.0
    strict = met.strict_rates(met.confusion(scored(spark, [(0.9, 1), (0.8, 1)]), ["center_id"])).first()
    assert strict["specificity"] is None and strict["balanced_accuracy"] is None


def test_tied_scores_and_score_at_the_threshold(spark):
    rows = [(0.5, 1), (0.5, 0), (0.7, 1), (0.1, 0), (0.5, 1), (0.9, 0)]
    out = met.all_metrics(scored(spark, rows), ["center_id"]).first()
    pairs = [(p, n) for p, y in rows if y == 1 for n, z in rows if z == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert out["auroc"] == pytest.approx(want)
    assert out["n_positives"] == 3 and out["recall"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("shift", [0.0, -3.0, 5.0])
def test_auroc_of_any_scores_and_partitions(spark, folder, shift):
    rows = V.scored_rows(spark, folder).withColumn("score", F.col("score") * 7 + shift + F.col("label") * 0.2)
    got = {r["center_id"]: r["auroc"] for r in met.auroc(rows, ["center_id"]).collect()}
    more = {r["center_id"]: r["auroc"] for r in met.auroc(rows.repartition(16), ["center_id"]).collect()}
    assert got == pytest.approx(more)
    local = rows.where("center_id = 3").collect()
    pairs = [(a["score"], b["score"]) for a in local if a["label"] == 1 for b in local if b["label"] == 0]
    assert got[3] == pytest.approx(sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs))


def test_threshold_index_on_grid_points(spark):
    grid = [i * 0.01 for i in range(101)] + [0.005, 0.995, 1.0, 0.0, 0.299999999]
    df = spark.createDataFrame([(s,) for s in grid], "score double")
    for r in df.withColumn("i", met.threshold_index(F.col("score"))).collect():
        assert r["i"] == sum(i * 0.01 < r["score"] for i in range(101))


@pytest.mark.parametrize("metric", ["balanced_accuracy", "f1", "accuracy"])
def test_best_threshold_by_trying_all(spark, folder, metric):
    rows = V.scored_rows(spark, folder).where("center_id < 3")
    got = {r["center_id"]: r["threshold"] for r in met.best_threshold(rows, ["center_id"], metric).collect()}
    best = {}
    for i in range(101):
        t = i * 0.01
        for r in met.with_rates(met.confusion(rows, ["center_id"], t)).collect():
            if r[metric] > best.get(r["center_id"], (0.0, 0.5))[0]:
                best[r["center_id"]] = (r[metric], t)
        if i > 30 and metric != "accuracy":
            break
    assert got == pytest.approx({c: best.get(c, (0, 0.5))[1] for c in got})


def test_no_threshold_beats_zero(spark):
    out = met.best_threshold(scored(spark, [(0.4, 0), (0.2, 0)]), ["center_id"], "recall").first()
    assert out["threshold"] == 0.5 and out["best_value"] == 0.0


def test_gaps_need_two_groups(spark):
    rows = []
    for attribute, groups in [("one", ["a"]), ("two", ["a", "b"]), ("three", ["a", "b", "c"])]:
        rows += [(attribute, groups[i % len(groups)], 0.9 if i % 3 else 0.1, float(i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "name string, g string, score double, label double")
    for name, n in [("one", 0), ("two", 1), ("three", 0)]:
        part = df.where(F.col("name") == name).withColumn("center_id", F.lit(0))
        rates = fairness.group_rates(part, ["g"], ["center_id"])
        assert fairness.opportunity_gaps(rates, ["center_id"]).count() == n


def test_absent_attributes_are_skipped(spark, folder):
    rows = V.scored_rows(spark, folder)
    assert fairness.present_attributes(rows, ["parity", "nothing", 0, 9], ["score"]) == ["parity", "score"]


def test_one_run_has_no_deviation(spark):
    rows = spark.createDataFrame([(1, 1, "test", 0, "f1", 0.5, 10)], "run int, round int, phase string, center_id int, metric string, value double, n_rows bigint")
    assert rs.center_summary(rows).first()["std"] is None


def test_grid_names_and_overrides(spark):
    grid = rs.condition_grid(spark, "g", ["a", "b"], [1, 3], [0.7, None], ["xgb", "random_forest"], fixed_clients={"b": 4}).collect()
    assert len(grid) == 2 * 2 * 2 + 2 * 2
    assert {r["num_clients"] for r in grid if r["dataset"] == "b"} == {4}
    assert {r["num_rounds"] for r in grid if "forest" in r["model"]} == {1}
    assert "g_a_xgb_c1_aNone_normglobal_featNone" in {r["name"] for r in grid}
    seeds = rs.repetitions(rs.condition_grid(spark, "g", ["a"], [1], [None], ["xgb"])).select("seed").collect()
    assert sorted(r["seed"] for r in seeds) == [10, 11, 12, 13, 14]
