"""Whole experiments: every model by name, from a raw table to the summary."""

import pytest
from pyspark.sql import functions as F

from centrum.operators import fairness, results as rs
from centrum.plans import experiment as ex, views as V
from centrum.sources import sinks


@pytest.fixture(scope="module")
def prepared(spark, folder):
    raw = V.planted_rows(spark, folder).drop("center_id", "label")
    rows, names = ex.prepare(
        raw, "row_key", "y", V.NUMERIC, V.TEXT, num_clients=3, dirichlet_alpha=5.0, preprocessing="weighted_aggregate", keep=["l_linestatus"]
    )
    return rows.persist(), names


def test_prepare(prepared):
    rows, names = prepared
    assert names == V.NUMERIC + V.TEXT
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("p"), F.count_distinct("center_id").alias("k"), F.max(F.size("features")).alias("w")).first()
    assert out["n"] == 6000 and out["p"] == pytest.approx(0.5, abs=0.01) and out["k"] == 3 and out["w"] == 6
    assert {r["l_linestatus"] for r in rows.select("l_linestatus").distinct().collect()} == {"F", "O"}
    z = rows.agg(F.avg(F.col("features")[1]).alias("m"), F.stddev_samp(F.col("features")[1]).alias("s")).first()
    assert z["m"] == pytest.approx(0, abs=0.01) and z["s"] == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("preprocessing", ["reference", "equal_aggregate"])
def test_prepare_selects_features(spark, folder, preprocessing):
    rows, names = ex.prepare(
        V.planted_rows(spark, folder).drop("center_id", "label"), "row_key", "y", V.NUMERIC, [], num_clients=3,
        partition_by_attribute=0, dirichlet_alpha=1.0, preprocessing=preprocessing, n_features=2, selection="f_classif",
    )
    assert len(names) == 2 and "l_extendedprice" in names and rows.where(F.size("features") != 2).isEmpty()


def by_phase(history, metric):
    return {r["phase"]: r["v"] for r in history.where(F.col("metric") == metric).groupBy("phase").agg(F.avg("value").alias("v")).collect()}


@pytest.mark.parametrize(
    "model,settings",
    [
        ("logistic_regression", {"rate": 1.0, "local_steps": 8}),
        ("xgb", {"depth": 2, "rate": 0.5}),
        ("xgblr", {"trees_per_center": 1, "depth": 2, "local_steps": 3}),
        ("balanced_random_forest", {"tree_num": 3, "depth": 4, "combine": "random"}),
    ],
)
def test_models(prepared, model, settings):
    rows, names = prepared
    history = ex.run(rows, len(names), model, num_rounds=2 if model == "logistic_regression" else 1, **settings)
    area = by_phase(history, "auroc")
    assert {"val", "test", "not tuned"} <= set(area)
    assert area["test"] > 0.9
    if model in ex.LINEAR:
        assert {"local", "personalized"} <= set(area)
    best = rs.best_round(history.where("phase <> 'fit'"))
    assert best.first()["best_round"] in (1, 2)
    summary = rs.center_summary(rs.at_best_round(history.where("phase <> 'fit'"), best))
    assert rs.model_comparison(summary).where("model = 'federated'").count() == 3


def test_unknown_names(prepared):
    with pytest.raises(ValueError):
        ex.run(prepared[0], 6, "nn")
    with pytest.raises(ValueError):
        ex.source("parquet lake")
    assert ex.source("csv") is ex.readers.read_csv


def test_history_can_be_appended(spark, folder, tmp_path):
    path = str(tmp_path / "h")
    metrics = V.round_history(spark, folder)
    for r in (0, 1):
        sinks.append_history(metrics.where(F.col("run") == r), path)
    assert spark.read.parquet(path).count() == metrics.where("run < 2").count()


@pytest.mark.parametrize("task,model", [("MULTICLASS", "xgb"), ("REG", "xgb"), ("REG", "catboost")])
def test_other_tasks(prepared, task, model):
    rows, names = prepared
    x = F.col("features")
    label = F.when(x[1] < -0.5, 3.0).when(x[1] < 0.5, 5.0).otherwise(9.0) if task == "MULTICLASS" else x[1] * 2 + x[0]
    history = ex.run(rows.withColumn("label", label), len(names), model, num_rounds=3, task="auto", depth=2, rate=0.9)
    assert {"val", "test"} <= {r["phase"] for r in history.select("phase").distinct().collect()}
    last = by_phase(history.where("round = 3"), "accuracy" if task == "MULTICLASS" else "r2")
    assert last["test"] > (0.9 if task == "MULTICLASS" else 0.6)
    if task == "REG":
        assert by_phase(history, "mse")["local"] > 0


def test_tasks_are_checked(prepared):
    for task, model in (("MULTICLASS", "lsvc"), ("REG", "random_forest"), ("RANKING", "xgb")):
        with pytest.raises(ValueError):
            ex.run(prepared[0], 6, model, task=task)


def test_gaps_between_groups_are_in_the_history(prepared):
    rows, names = prepared
    history = ex.run(rows, len(names), "xgb", num_rounds=1, depth=2, rate=0.5, attributes=["l_linestatus"])
    gaps = {(r["center_id"], r["metric"]): r["value"] for r in history.where("metric LIKE 'EO%'").collect()}
    assert set(gaps) == {(c, f"{m} l_linestatus") for c in range(3) for m in ("EOP", "EOD")} and all(0 <= v <= 1 for v in gaps.values())
