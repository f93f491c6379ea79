"""Metrics of scored rows by any keys: one aggregate for the counts, an exact AUROC, threshold tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from centrum.functions.columns import hard_label, ratio, sigmoid
from centrum.operators.ordering import join_params

RATES = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"]
BINARY = [*RATES, "auroc", "n_positives", "n_negatives"]


def confusion(df: DataFrame, keys: list[str], threshold: float | str = 0.5) -> DataFrame:
    """tp, fp, tn, fn per key; ``threshold`` is a number or the name of a column."""
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    pred, y = hard_label(F.col("score"), cut), F.col("label")
    return df.groupBy(*keys).agg(
        F.count_if((pred == 1) & (y == 1)).alias("tp"),
        F.count_if((pred == 1) & (y == 0)).alias("fp"),
        F.count_if((pred == 0) & (y == 0)).alias("tn"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"),
    )


def rate_columns(empty=0.0) -> dict[str, Column]:
    """Rates from tp, fp, tn, fn; ``empty`` stands for a zero denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, specificity = ratio(tp, tp + fn, empty), ratio(tn, tn + fp, empty)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, empty),
        "precision": ratio(tp, tp + fp, empty),
        "recall": recall,
        "specificity": specificity,
        "f1": ratio(2 * tp, 2 * tp + fp + fn, empty),
        "balanced_accuracy": (recall + specificity) / 2,
    }


def with_rates(counts: DataFrame, empty=0.0) -> DataFrame:
    return counts.withColumns(rate_columns(empty))


def strict_rates(counts: DataFrame) -> DataFrame:
    """The same measures with null where a denominator is zero, recall under its other name."""
    out = counts.withColumns(rate_columns(None)).withColumnRenamed("recall", "sensitivity")
    p, r = F.col("precision"), F.col("sensitivity")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def score_bucket(score: Column) -> Column:
    """A bucket number that never falls when the score rises: 2 ** 32 equal parts between each power of two and the next.

    A double has 2 ** 52 values there, so no bucket holds more than about a million different scores, however close
    together they lie."""
    size = F.least(F.abs(score), F.lit(1e300))
    power = F.floor(F.log2(size))
    place = F.floor((power + size / F.pow(F.lit(2.0), power) + F.lit(1100.0)) * F.lit(float(1 << 32)))
    signed = F.when(score == 0, F.lit(0)).otherwise(F.signum(score).cast("bigint") * place)
    return F.when(F.isnan(score), F.lit(1 << 62)).otherwise(signed).cast("bigint")


def collapsed_scores(df: DataFrame, keys: list[str], cut: Column) -> DataFrame:
    """Per (key, block of 2 ** 20 score buckets): class totals p and n, those above the cut (tp, fp), and the pair count u
    inside the block.

    Rows collapse to distinct scores on the map side; each (key, score bucket) is walked on its own, then the buckets of a
    block, so neither a large center nor a crowd of close scores is one task."""
    y = F.col("label")
    scores = (
        df.select(*keys, "score", "label", cut.alias("_cut"))
        .groupBy(*keys, "_cut", "score")
        .agg(F.sum((y == 1).cast("bigint")).alias("p"), F.sum((y == 0).cast("bigint")).alias("n"))
        .withColumn("_b", score_bucket(F.col("score")))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("n").over(inside) - F.col("n")
    above = F.col("score") > F.col("_cut")
    buckets = (
        scores.withColumn("_u", F.col("p") * (below + F.col("n") * F.lit(0.5)))
        .groupBy(*keys, "_b")
        .agg(
            F.sum("_u").alias("u"),
            F.sum("p").alias("p"),
            F.sum("n").alias("n"),
            F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("n")).otherwise(0)).alias("fp"),
        )
    )
    return _per_key(buckets.withColumn("_block", F.shiftright("_b", 20)), [*keys, "_block"]).withColumnRenamed("_block", "_b")


def _per_key(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets put together: u counts the (positive, lower negative) pairs of the whole key."""
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    lower = F.sum("n").over(upto) - F.col("n")
    sums = [F.sum(c).alias(c) for c in ("u", "p", "n", "tp", "fp")]
    return buckets.withColumn("u", F.col("u") + F.col("p") * lower).groupBy(*keys).agg(*sums)


def _area() -> Column:
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    return ratio(F.col("u"), p * n)


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact area under the ROC curve with ties; 0 when a class is missing."""
    whole = _per_key(collapsed_scores(df, keys, F.lit(0.5)), keys)
    return whole.select(*keys, _area().alias("auroc"))


def mean_squared_error(df: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.col("label") - F.col("score")
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("n_positives"), F.count_if(F.col("label") == 0).alias("n_negatives")
    )


def all_metrics(df: DataFrame, keys: list[str], threshold: float | str = 0.5) -> DataFrame:
    """One row per key with every binary metric and the row count, from one pass over the rows. A threshold column
    must be constant inside a key."""
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    whole = _per_key(collapsed_scores(df, keys, cut), keys).withColumns({"tn": F.col("n") - F.col("fp"), "fn": F.col("p") - F.col("tp")})
    return with_rates(whole).select(
        *keys,
        *RATES,
        _area().alias("auroc"),
        F.col("p").alias("n_positives"),
        F.col("n").alias("n_negatives"),
        (F.col("p") + F.col("n")).alias("n_rows"),
    )


def long_metrics(wide: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """(keys, metric, value, n_rows) from a wide table."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names or BINARY])
    return wide.select(*keys, "n_rows", F.explode(entries).alias("_m")).select(*keys, "_m.metric", "_m.value", "n_rows")


def threshold_index(score: Column) -> Column:
    """How many of the thresholds 0.00, 0.01, ..., 1.00 lie strictly below the score."""
    k = F.floor(score * 100.0)
    near = [((k + d) * F.lit(0.01) < score).cast("bigint") for d in (-1, 0, 1)]
    return F.greatest(F.lit(0), F.least(F.lit(101), k - 1 + near[0] + near[1] + near[2])).cast("int")


def threshold_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts at all 101 thresholds per key, from one histogram over the rows."""
    y = F.col("label")
    hist = (
        df.withColumn("_i", threshold_index(F.col("score")))
        .groupBy(*keys, "_i")
        .agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    )
    blank = hist.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(101))).alias("_i"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")
    )
    full = hist.unionByName(blank).groupBy(*keys, "_i").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    key = Window.partitionBy(*keys)
    above = key.orderBy("_i").rowsBetween(1, Window.unboundedFollowing)
    tp, fp = F.coalesce(F.sum("p").over(above), F.lit(0)), F.coalesce(F.sum("n").over(above), F.lit(0))
    out = full.select(
        *keys,
        (F.col("_i") * F.lit(0.01)).alias("threshold"),
        "_i",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("n").over(key) - fp).alias("tn"),
        (F.sum("p").over(key) - tp).alias("fn"),
    )
    return out.where(F.col("_i") <= 100).drop("_i")


def best_threshold(df: DataFrame, keys: list[str], metric: str = "balanced_accuracy") -> DataFrame:
    """The smallest threshold with the best value; 0.5 when no threshold does better than 0. A metric that does
    not depend on the threshold is best at 0.00 when positive."""
    curve = threshold_curve(df, keys)
    if metric == "auroc":
        area = auroc(df, keys)
        return area.select(
            *keys, F.when(F.col("auroc") > 0, 0.0).otherwise(0.5).alias("threshold"), F.col("auroc").alias("best_value")
        )
    rated = curve.withColumn("_v", rate_columns()[metric])
    best = rated.groupBy(*keys).agg(F.max("_v").alias("best_value"), F.min_by("threshold", F.struct(-F.col("_v"), F.col("threshold"))).alias("_t"))
    return best.select(*keys, F.when(F.col("best_value") > 0, F.col("_t")).otherwise(0.5).alias("threshold"), "best_value")


def tuned_metrics(df: DataFrame, keys: list[str], metric: str = "balanced_accuracy", split: str = "split") -> DataFrame:
    """Three phases per key: ``val`` and ``test`` at the threshold tuned on the validation rows, and ``not tuned``
    (test rows at 0.5). The phases are marked on the rows, so all of them share one aggregate."""
    tuned = best_threshold(df.where(F.col(split) == "val"), keys, metric).select(*keys, "threshold")
    rows = join_params(df.where(F.col(split).isin("val", "test")), tuned, keys, "left")
    half = F.lit(0.5)
    tuned_cut = F.coalesce("threshold", half)
    phases = F.when(F.col(split) == "val", F.array(F.struct(F.lit("val").alias("phase"), tuned_cut.alias("cut")))).otherwise(
        F.array(
            F.struct(F.lit("test").alias("phase"), tuned_cut.alias("cut")),
            F.struct(F.lit("not tuned").alias("phase"), half.alias("cut")),
        )
    )
    marked = rows.select(*keys, "score", "label", F.explode(phases).alias("_p")).select(*keys, "score", "label", "_p.phase", "_p.cut")
    return all_metrics(marked, [*keys, "phase"], "cut")


def log_loss(df: DataFrame, keys: list[str], eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped away from 0."""
    p = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return df.groupBy(*keys).agg(F.avg(-F.ln(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)))).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def loss_of(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The loss an evaluation reports: log loss, 1 - AUROC, mean squared error, or the constant 1."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if kind == "log_loss":
        return log_loss(df, keys)
    if kind == "one_minus_auroc":
        return auroc(df, keys).join(sizes, keys).select(*keys, (1 - F.col("auroc")).alias("loss"), "n_rows")
    if kind == "mse":
        return mean_squared_error(df, keys).join(sizes, keys).select(*keys, F.col("mse").alias("loss"), "n_rows")
    if kind == "constant":
        return sizes.select(*keys, F.lit(1.0).alias("loss"), "n_rows")
    raise ValueError(f"unknown loss {kind!r}")


def multiclass_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of exact matches of ``prediction``, and one minus it as the loss."""
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return df.groupBy(*keys).agg(hit.alias("accuracy")).withColumn("loss", 1 - F.col("accuracy"))


def regression_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with mse, mae and r2 of ``score`` against ``label``, and the row count; r2 is 0 for a constant label."""
    error = F.col("label") - F.col("score")
    spread = F.var_pop("label")
    mse = F.avg(error * error)
    return df.groupBy(*keys).agg(
        mse.alias("mse"), F.avg(F.abs(error)).alias("mae"), F.when(spread > 0, 1 - mse / spread).otherwise(0.0).alias("r2"), F.count(F.lit(1)).alias("n_rows")
    )


def merge_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Plain mean of each metric over the centers, with the centers' values and row counts in center order."""
    ordered = F.array_sort(F.collect_list(F.struct("center_id", "value", "n_rows")))
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("value"), ordered.alias("_l")).select(
        *keys, "metric", "value", F.col("_l.value").alias("per_center"), F.col("_l.n_rows").alias("per_center_rows")
    )


def squash_margin(df: DataFrame) -> DataFrame:
    """Margins as scores in (0, 1), so that thresholds mean the same for all models."""
    return df.withColumn("score", sigmoid(F.col("score")))


def accumulated_time(metrics: DataFrame) -> DataFrame:
    """Running sum of the round times per run."""
    upto = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.withColumn("training_time", F.sum("round_time").over(upto))
