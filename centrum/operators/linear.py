"""Linear models of all centers in one job: gradients are summed by center inside generated code, and only
parameter-sized tables are stepped and merged."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from centrum.functions.columns import dot, sigmoid
from centrum.operators.ordering import join_params, settle

WIDE = 128
MODEL = "center_id int, coef array<double>, intercept double, n_rows bigint"


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 * n_class) per center and label, from the class counts."""
    counts = df.groupBy("center_id", label).agg(F.count(F.lit(1)).alias("n_class"))
    sizes = counts.groupBy("center_id").agg(F.sum("n_class").alias("n_rows"))
    return counts.join(sizes, "center_id").select(
        "center_id", label, (F.col("n_rows") / (2.0 * F.col("n_class"))).alias("weight")
    )


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with their class weight in column ``weight``."""
    return join_params(df, class_weights(df, label), ["center_id", label])


def _margin_of_row(width: int, coef: Column, intercept: Column) -> Column:
    x = F.col("features")
    if width > WIDE:
        return dot(x, coef) + intercept
    return reduce(lambda s, i: s + x[i] * coef[i], range(width), intercept)


def _shared_values(model: DataFrame) -> tuple[Column, Column]:
    """(coef, intercept) of a single model. Both sit in one array constant, so the generated code stays the same
    from round to round and is compiled once."""
    one = model.select("coef", "intercept").first()
    packed = F.lit([float(one["intercept"]), *[float(c) for c in one["coef"]]])
    return F.slice(packed, 2, len(one["coef"])), packed[0]


def _residual(loss: str, margin: Column, label: Column) -> tuple[Column, Column]:
    """(d loss / d margin, loss) of one row."""
    if loss == "log":
        p = sigmoid(margin)
        return p - label, F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - label * margin
    if loss == "hinge":
        side = label * 2 - 1
        short = side * margin < 1
        return F.when(short, -side).otherwise(F.lit(0.0)), F.greatest(F.lit(0.0), 1 - side * margin)
    if loss == "squared":
        return margin - label, (margin - label) * (margin - label)
    raise ValueError("loss must be 'log', 'hinge' or 'squared'")


def gradient_sums(rows: DataFrame, models: DataFrame, width: int, loss: str) -> DataFrame:
    """Per center: rows, weight sum, weighted loss and hit sums, and the gradient sums ``grad`` (intercept last).

    ``models`` has one row per center (or a single row without center_id, shared by all)."""
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.select("center_id", "features", F.col("label").cast("double").alias("label"), "weight")
    if "center_id" in models.columns:
        joined = join_params(rows, models.select("center_id", "coef", "intercept"), "center_id")
        margin = _margin_of_row(width, F.col("coef"), F.col("intercept"))
    else:
        joined = rows
        margin = _margin_of_row(width, *_shared_values(models))
    slope, value = _residual(loss, margin, F.col("label"))
    hit = (margin > 0).cast("double") == F.col("label")
    scored = joined.select(
        "center_id",
        "features",
        "weight",
        (F.col("weight") * slope).alias("_r"),
        (F.col("weight") * value).alias("_l"),
        F.when(hit, F.col("weight")).otherwise(0.0).alias("_h"),
    )
    common = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("weight").alias("weight_sum"),
        F.sum("_l").alias("loss_sum"),
        F.sum("_h").alias("hit_sum"),
    ]
    if width <= WIDE:
        parts = [F.sum(F.col("_r") * F.col("features")[i]) for i in range(width)] + [F.sum("_r")]
        return scored.groupBy("center_id").agg(*common, F.array(*parts).alias("grad"))
    return wide_gradients(scored, common)


def wide_gradients(scored: DataFrame, common: list[Column]) -> DataFrame:
    """Gradient sums for many features: each Arrow batch is reduced to one partial vector per center."""

    def partial(batches):
        for pdf in batches:
            for center, part in pdf.groupby("center_id", sort=False):
                r = part["_r"].to_numpy()
                x = np.stack(part["features"].to_numpy())
                g = np.append(r @ x, r.sum())
                yield pd.DataFrame({"center_id": np.int64(center), "pos": np.arange(len(g)), "g": g})

    sums = scored.select("center_id", "features", "_r").mapInPandas(partial, "center_id bigint, pos int, g double")
    vectors = (
        sums.groupBy("center_id", "pos")
        .agg(F.sum("g").alias("g"))
        .groupBy("center_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "g"))).alias("_v"))
        .select("center_id", F.col("_v.g").alias("grad"))
    )
    return scored.groupBy("center_id").agg(*common).join(vectors, "center_id")


def shared_start(df: DataFrame, width: int, coef=None, intercept: float = 0.0) -> DataFrame:
    """A single starting model (zeros unless given)."""
    start = [float(c) for c in coef] if coef is not None else [0.0] * width
    return one_model(df.sparkSession, start, intercept)


def one_model(spark, coef: list[float], intercept: float) -> DataFrame:
    """A model row."""
    table = pa.table({"coef": pa.array([list(coef)], pa.list_(pa.float64())), "intercept": pa.array([float(intercept)])})
    return spark.createDataFrame(table)


def per_center(models: DataFrame, sums: DataFrame) -> DataFrame:
    """Gradient sums beside the model they were taken at."""
    if "center_id" in models.columns:
        return sums.join(models.select("center_id", "coef", "intercept"), "center_id")
    coef, intercept = _shared_values(models)
    return sums.withColumn("coef", coef).withColumn("intercept", intercept)


def _stepped(at: DataFrame, coef: Column, rate: float) -> DataFrame:
    slope = F.element_at("grad", -1) / F.col("n_rows")
    return at.select("center_id", coef.alias("coef"), (F.col("intercept") - rate * slope).alias("intercept"), "n_rows")


def logistic_step(at: DataFrame, rate: float, c: float = 1.0) -> DataFrame:
    """One damped full-batch step of L2-penalised logistic regression (penalty 1 / (c * n) per row)."""
    n = F.col("n_rows")
    return _stepped(
        at, F.zip_with("coef", F.slice("grad", 1, F.size("coef")), lambda w, g: w - rate * (g / n + w / (c * n))), rate
    )


def hinge_step(at: DataFrame, rate: float, alpha: float = 1e-4) -> DataFrame:
    """One subgradient step of the linear SVM."""
    n = F.col("n_rows")
    return _stepped(
        at, F.zip_with("coef", F.slice("grad", 1, F.size("coef")), lambda w, g: w - rate * (g / n + alpha * w)), rate
    )


def elastic_step(at: DataFrame, rate: float, alpha: float = 1e-4, l1_ratio: float = 0.5) -> DataFrame:
    """One proximal step of elastic-net logistic regression: gradient, soft threshold, shrink."""
    n = F.col("n_rows")
    cut, shrink = rate * alpha * l1_ratio, 1.0 + rate * alpha * (1.0 - l1_ratio)

    def move(w: Column, g: Column) -> Column:
        v = w - rate * g / n
        return F.signum(v) * F.greatest(F.abs(v) - cut, F.lit(0.0)) / shrink

    return _stepped(at, F.zip_with("coef", F.slice("grad", 1, F.size("coef")), move), rate)


def squared_step(at: DataFrame, rate: float) -> DataFrame:
    """One least-squares step, used for regression heads."""
    n = F.col("n_rows")
    return _stepped(at, F.zip_with("coef", F.slice("grad", 1, F.size("coef")), lambda w, g: w - rate * g / n), rate)


ALGORITHMS = {
    "logistic_regression": ("log", logistic_step),
    "lsvc": ("hinge", hinge_step),
    "elastic_net": ("log", elastic_step),
    "regression": ("squared", squared_step),
}


def proximal_pull(stepped: DataFrame, shared: DataFrame, mu: float = 0.02) -> DataFrame:
    """w - mu * (w - w_shared) for coefficients and intercept."""
    one = shared.select("coef", "intercept").first()
    return stepped.select(
        "center_id",
        F.zip_with("coef", F.lit(list(one["coef"])), lambda w, v: w - mu * (w - v)).alias("coef"),
        (F.col("intercept") - mu * (F.col("intercept") - F.lit(one["intercept"]))).alias("intercept"),
        "n_rows",
    )


def local_round(
    rows: DataFrame,
    shared: DataFrame,
    width: int,
    algorithm: str = "logistic_regression",
    rate: float = 0.5,
    steps: int = 1,
    mu: float = 0.0,
    average: bool | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """``steps`` local passes of every center from its model (or the shared one), with the proximal pull when
    mu > 0. The SVM and the elastic net hand back the mean of their iterates. With a ``tolerance``, passes end when
    no coefficient of any center moves by more."""
    loss, step = ALGORITHMS[algorithm]
    average = algorithm in ("lsvc", "elastic_net") if average is None else average
    models, mean = shared, None
    for i in range(steps):
        before, at = models, per_center(models, gradient_sums(rows, models, width, loss))
        models = step(at, rate)
        if mu > 0:
            models = proximal_pull(models, shared, mu)
        if steps > 1:
            models = settle(models)
        mean = models if mean is None else running_mean(mean, models, i + 1)
        if tolerance > 0 and i and largest_move(before, models) <= tolerance:
            break
    return mean if average else models


def largest_move(before: DataFrame, after: DataFrame) -> float:
    """The largest change of any coefficient or intercept of any center; both tables hold one small row a center."""
    old = before.select("center_id", F.col("coef").alias("_c"), F.col("intercept").alias("_i"))
    moves = F.concat(F.zip_with("coef", "_c", lambda a, b: F.abs(a - b)), F.array(F.abs(F.col("intercept") - F.col("_i"))))
    return after.join(old, "center_id").agg(F.max(F.array_max(moves))).first()[0] or 0.0


def running_mean(mean: DataFrame, models: DataFrame, count: int) -> DataFrame:
    """Mean of ``count`` iterates from the mean of the first count - 1 and the newest one."""
    new = models.select("center_id", F.col("coef").alias("_c"), F.col("intercept").alias("_i"), "n_rows")
    return settle(
        mean.drop("n_rows")
        .join(new, "center_id")
        .select(
            "center_id",
            F.zip_with("coef", "_c", lambda a, b: a + (b - a) / count).alias("coef"),
            (F.col("intercept") + (F.col("_i") - F.col("intercept")) / count).alias("intercept"),
            "n_rows",
        )
    )


def score_linear(rows: DataFrame, model: DataFrame, width: int, probability: bool = True, out: str = "score") -> DataFrame:
    """Probability, or the raw margin of the SVM. Per-center models score their own center's rows."""
    if "center_id" in model.columns:
        joined = join_params(rows, model.select("center_id", "coef", "intercept"), "center_id")
        margin = _margin_of_row(width, F.col("coef"), F.col("intercept"))
    else:
        joined = rows
        margin = _margin_of_row(width, *_shared_values(model))
    scored = joined.withColumn(out, sigmoid(margin) if probability else margin)
    return scored.drop("coef", "intercept")
