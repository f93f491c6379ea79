"""Summaries over rounds, centers, runs and grids. Input: metrics(run, round, phase, center_id, metric, value, n_rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

HEADLINE = ["accuracy", "balanced_accuracy", "f1", "precision", "recall", "specificity"]


def best_round(metrics: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Per run, the first round with the largest mean validation metric over the centers."""
    mean = metrics.where((F.col("phase") == "val") & (F.col("metric") == metric)).groupBy("run", "round").agg(F.avg("value").alias("v"))
    order = F.struct(F.round("v", 12).alias("v"), (-F.col("round")).alias("r"))
    return mean.groupBy("run").agg(F.max_by("round", order).alias("best_round"), F.max("v").alias("best_value"))


def at_best_round(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """Metric values per center at the best round; those of local models come from the first round."""
    first = metrics.groupBy("run").agg(F.min("round").alias("_first"))
    wanted = F.when(F.col("phase") == "local", F.col("_first")).otherwise(F.col("best_round"))
    return (
        metrics.join(best.select("run", "best_round"), "run").join(first, "run").where(F.col("round") == wanted).drop("best_round", "_first")
    )


def center_summary(chosen: DataFrame) -> DataFrame:
    """Mean and population deviation over the runs per (phase, metric, center)."""
    return chosen.groupBy("phase", "metric", "center_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n_runs")
    ).withColumn("std", F.when(F.col("n_runs") > 1, F.col("std")))


def weighted_summary(summary: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over the centers weighted by their rows, and the weighted deviation around it."""
    joined = summary.join(weights, "center_id")
    key = Window.partitionBy("phase", "metric")
    w, m = F.col("n_rows"), F.col("mean")
    joined = joined.withColumn("_m", F.sum(w * m).over(key) / F.sum(w).over(key))
    return joined.groupBy("phase", "metric").agg(
        F.first("_m").alias("mean"), F.sqrt(F.sum(w * (m - F.col("_m")) * (m - F.col("_m"))) / F.sum(w)).alias("std")
    )


def first_run_weights(chosen: DataFrame) -> DataFrame:
    """Rows per center in the first run's test phase."""
    test = chosen.where(F.col("phase") == "test")
    return test.groupBy("center_id").agg(F.min_by("n_rows", F.struct("run", "metric")).alias("n_rows"))


def held_out(central: DataFrame, best: DataFrame) -> DataFrame:
    """Held-out values per (run, metric): the only round's, or those of the best round."""
    rounds = central.groupBy("run").agg(F.count_distinct("round").alias("_n"), F.min("round").alias("_only"))
    wanted = F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("best_round"))
    return (
        central.join(rounds, "run").join(best.select("run", "best_round"), "run").where(F.col("round") == wanted).select("run", "metric", "value")
    )


def last_training_time(times: DataFrame) -> DataFrame:
    """Accumulated training time at the last round of each run."""
    return times.groupBy("run").agg(F.max_by("training_time", "round").alias("training_time"))


def center_pivot(summary: DataFrame, train_sizes: DataFrame, names: list[str], phase: str = "test") -> DataFrame:
    """One wide row per center: metric, metric_std and the number of training rows."""
    part = summary.where((F.col("phase") == phase) & F.col("metric").isin(names))
    wide = part.groupBy("center_id").pivot("metric", names).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    for n in names:
        wide = wide.withColumnRenamed(f"{n}_mean", n)
    return wide.join(train_sizes, "center_id")


def train_sizes(test_sizes: DataFrame) -> DataFrame:
    """Training rows when only the test rows of a 20 percent split are known: 5 * n - 1."""
    return test_sizes.select("center_id", (5 * F.col("n_rows") - 1).alias("train_n_samples"))


def display_names(centers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A name per center: from the list, else center_<i+1>."""
    spark = centers.sparkSession
    table = spark.createDataFrame(list(enumerate(names or [])), "center_id int, _name string")
    default = F.concat(F.lit("center_"), (F.col("center_id") + 1).cast("string"))
    return centers.join(table, "center_id", "left").withColumn("center", F.coalesce("_name", default)).drop("_name")


def with_section(metrics: DataFrame) -> DataFrame:
    """The report section of a phase."""
    section = (
        F.when(F.col("phase") == "val", "Validation set")
        .when(F.col("phase") == "local", "Non federated")
        .when(F.col("phase") == "personalized", "Federated finetuned locally")
        .when(F.col("phase") == "held out", "Held-out set")
        .otherwise("Test set")
    )
    return metrics.withColumn("section", section)


def execution_stats(chosen: DataFrame, names: list[str]) -> DataFrame:
    """Mean over everything and the deviation over runs of the run means, per execution metric."""
    runs = chosen.where(F.col("metric").isin(names)).groupBy("metric", "run").agg(
        F.avg("value").alias("m"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return runs.groupBy("metric").agg((F.sum("s") / F.sum("n")).alias("mean"), F.stddev_pop("m").alias("std"))


def model_comparison(summary: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Federated, local and personalised rows per center with one column per metric."""
    names = names or HEADLINE
    model = F.when(F.col("phase") == "test", "federated").otherwise(F.col("phase"))
    part = summary.where(F.col("phase").isin("test", "local", "personalized") & F.col("metric").isin(names))
    return part.withColumn("model", model).groupBy("center_id", "model").pivot("metric", names).agg(F.first("mean"))


def size_and_quality(wide: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Center size against a metric, with the center's share of all rows."""
    share = F.col("train_n_samples") / F.sum("train_n_samples").over(Window.partitionBy())
    return wide.select("center_id", "train_n_samples", metric, share.alias("share"))


def condition_grid(
    spark: SparkSession,
    experiment: str,
    datasets: list[str],
    clients: list[int],
    alphas: list[float | None],
    models: list[str],
    normalizations: list[str | None] = ("global",),
    n_features: list[int | None] = (None,),
    fixed_clients: dict[str, int] | None = None,
    rounds: int = 60,
    forest_rounds: int = 1,
) -> DataFrame:
    """The product of all settings with the overrides per dataset and model, and a name for each condition."""
    def values(name, items, dtype):
        return F.explode(F.array(*[F.lit(i).cast(dtype) for i in items])).alias(name)

    one = spark.range(1).select(values("dataset", datasets, "string"))
    for name, items, dtype in [
        ("num_clients", clients, "int"),
        ("alpha", alphas, "double"),
        ("model", models, "string"),
        ("normalization", normalizations, "string"),
        ("n_features", n_features, "int"),
    ]:
        one = one.select("*", values(name, items, dtype))
    k = F.col("num_clients")
    for name, n in (fixed_clients or {}).items():
        k = F.when(F.col("dataset") == name, F.lit(n)).otherwise(k)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    grid = one.withColumn("num_clients", k).withColumn(
        "num_rounds", F.when(F.col("model").contains("forest"), forest_rounds).otherwise(rounds)
    )
    label = F.concat(
        F.lit(f"{experiment}_"), F.col("dataset"), F.lit("_"), F.col("model"), F.lit("_c"), text("num_clients"),
        F.lit("_a"), text("alpha"), F.lit("_norm"), text("normalization"), F.lit("_feat"), text("n_features"),
    )
    return grid.withColumn("name", label).distinct()


def repetitions(grid: DataFrame, runs: int = 5, first_seed: int = 10) -> DataFrame:
    """Every condition ``runs`` times with the seeds first_seed, first_seed + 1, ..."""
    return grid.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("seed", F.col("run") - 1 + first_seed)


def run_summary(metrics: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """At the best round of each run: the mean over centers and the centers' values in order, per (phase, metric)."""
    chosen = at_best_round(metrics, best_round(metrics, metric))
    ordered = F.array_sort(F.collect_list(F.struct("center_id", "value")))
    return chosen.groupBy("run", "round", "phase", "metric").agg(F.avg("value").alias("value"), ordered.alias("_l")).select(
        "run", "round", "phase", "metric", "value", F.col("_l.value").alias("per_center")
    )
