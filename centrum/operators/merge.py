"""Merge the centers' models: weighted means of parameters, and unions of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from centrum.functions.columns import HASH_RANGE, row_hash
from centrum.operators.ordering import interval_join, running_sums


def smoothed_weights(sizes: DataFrame, method: str | None = None, strength: float = 0.5) -> DataFrame:
    """Center weights between the share of rows d and the equal share h = 1/k.

    EqualVoting d(1-s) + hs; SlowerQuartile (d + (d+h)/2)/2; any other name (h + (d+h)/2)/2; no method h."""
    whole = Window.partitionBy()
    d = F.col("n_rows") / F.sum("n_rows").over(whole)
    h = F.lit(1.0) / F.count(F.lit(1)).over(whole)
    if method in (None, "None"):
        weight = h
    elif method == "EqualVoting":
        weight = d * (1.0 - strength) + h * strength
    elif method == "SlowerQuartile":
        weight = (d + (d + h) / 2) / 2
    else:
        weight = (h + (d + h) / 2) / 2
    return sizes.select("center_id", weight.alias("weight"))


def parameter_rows(models: DataFrame) -> DataFrame:
    """(center_id, n_rows, pos, value), the intercept at position -1."""
    every = F.concat(F.array("intercept"), "coef")
    return models.select("center_id", "n_rows", F.posexplode(every).alias("pos", "value")).withColumn("pos", F.col("pos") - 1)


def as_model(merged: DataFrame) -> DataFrame:
    """(pos, value) rows back to one model row."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return merged.agg(ordered.alias("_v")).select(
        F.slice(F.col("_v.value"), 2, F.size("_v") - 1).alias("coef"), F.col("_v.value")[0].alias("intercept")
    )


def fedavg_parameters(models: DataFrame) -> DataFrame:
    """Row-count-weighted mean of every parameter, as (pos, value)."""
    return parameter_rows(models).groupBy("pos").agg(
        (F.sum(F.col("n_rows") * F.col("value")) / F.sum("n_rows")).alias("value")
    )


def weighted_parameters(models: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight * parameter with given center weights, as (pos, value)."""
    return parameter_rows(models).join(weights, "center_id").groupBy("pos").agg(
        F.sum(F.col("weight") * F.col("value")).alias("value")
    )


def merge_linear(models: DataFrame, smoothing: str | None = None, strength: float = 0.5, width: int | None = None) -> DataFrame:
    """One merged model row: plain row-weighted averaging, or averaging with smoothed weights. With a known moderate
    ``width`` the parameters are averaged side by side instead of being taken apart into rows."""
    plain = smoothing in (None, "None")
    if width is None or width > 128:
        if plain:
            return as_model(fedavg_parameters(models))
        return as_model(weighted_parameters(models, smoothed_weights(models.select("center_id", "n_rows"), smoothing, strength)))
    if not plain:
        models = models.join(smoothed_weights(models.select("center_id", "n_rows"), smoothing, strength), "center_id")
    w = F.col("n_rows") if plain else F.col("weight")
    mean = lambda c: F.sum(w * c) / (F.sum(w) if plain else F.lit(1.0))
    return models.agg(F.array(*[mean(F.col("coef")[i]) for i in range(width)]).alias("coef"), mean(F.col("intercept")).alias("intercept"))


def renumber(trees: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """New consecutive tree ids in the given order, found on the tree index in ranges of that order."""
    keys = list(dict.fromkeys(order))
    placed = running_sums(trees.select(*keys).distinct(), keys, new_id=F.lit(1))
    return trees.join(placed.select(*keys, (F.col("new_id_before") + start).cast("int").alias("new_id")), keys)


def forest_random_draw(index: DataFrame, seed: int = 42) -> DataFrame:
    """T // k trees drawn with replacement from each center (k centers of T trees): (center_id, draw, tree_id)."""
    per = index.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_trees"), F.array_sort(F.collect_list("tree_id")).alias("_ids"))
    k = F.count(F.lit(1)).over(Window.partitionBy())
    drawn = per.withColumn("_take", F.floor(F.col("n_trees") / k).cast("int")).where("_take > 0")
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_take") - 1)))
    pick = (row_hash(F.col("draw"), seed, F.col("center_id")) % F.col("n_trees")).cast("int")
    return drawn.select("center_id", "draw", F.element_at("_ids", pick + 1).alias("tree_id"))


def forest_weighted_draw(index: DataFrame, weights: DataFrame, n_draws: int, seed: int = 42) -> DataFrame:
    """``n_draws`` trees with probability proportional to their center's weight: (draw, center_id, tree_id, weight).

    Every tree owns a slice of the hash range; a draw is the tree whose slice holds its hash."""
    weighted = index.join(weights, "center_id")
    whole = weighted.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    shares = weighted.withColumn("weight", F.col("weight") / F.lit(whole["weight"]).cast("double"))
    slices = running_sums(shares, ["center_id", "tree_id"], hi=F.col("weight"), place=F.lit(1))
    upper = F.when(F.col("place") == whole["n"], F.lit(HASH_RANGE)).otherwise(F.floor(F.col("hi") * HASH_RANGE)).cast("bigint")
    lower = F.floor(F.col("hi_before") * HASH_RANGE)
    slices = slices.select(
        F.lit(0).alias("_all"), "center_id", "tree_id", "weight", lower.alias("lo"), upper.alias("hi"), F.lit(HASH_RANGE).alias("_range_s")
    )
    draws = index.sparkSession.range(n_draws).select(F.col("id").cast("int").alias("draw"), F.lit(0).alias("_all"))
    draws = draws.withColumn("_u", row_hash(F.col("draw"), seed)).withColumn("_range_r", F.lit(HASH_RANGE))
    return interval_join(draws, slices, ["_all"], "_u", "_range_r", "_range_s").select("draw", "center_id", "tree_id", "weight")


def take_trees(trees: DataFrame, draws: DataFrame, order: list[str]) -> DataFrame:
    """The node rows of the drawn trees, one copy per draw, renumbered in the given order."""
    chosen = trees.join(draws, ["center_id", "tree_id"])
    return renumber(chosen, order).drop("tree_id", "draw").withColumnRenamed("new_id", "tree_id")


def accumulate(previous: DataFrame, current: DataFrame, previous_first: bool = True) -> DataFrame:
    """Trees of earlier rounds and of this one in one forest; ids follow the order of the two parts."""
    first, second = (previous, current) if previous_first else (current, previous)
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return renumber(both, ["_part", "tree_id"]).drop("_part", "tree_id").withColumnRenamed("new_id", "tree_id")


def bagging_merge(previous: DataFrame | None, current: DataFrame, iteration: int) -> DataFrame:
    """Append every center's new trees: ids continue after the previous ones in center order, and the boosting
    iteration is kept as a column."""
    top = None if previous is None else previous.agg(F.max("tree_id")).first()[0]
    start = 0 if top is None else top + 1
    added = renumber(current, ["center_id", "tree_id"], start).drop("tree_id").withColumnRenamed("new_id", "tree_id")
    added = added.withColumn("iteration", F.lit(iteration))
    return added if previous is None else previous.unionByName(added, allowMissingColumns=True)


def largest_model(trees: DataFrame, sizes: DataFrame) -> DataFrame:
    """The whole model of the center with most rows."""
    top = sizes.orderBy(F.desc("n_rows"), "center_id").limit(1).select("center_id")
    return trees.join(top, "center_id", "left_semi")


def step_sizes(sizes: DataFrame, rate: float, mode: str = "uniform") -> DataFrame:
    """The boosting rate of each center: rate * n_c / N when weighted, else rate."""
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()) if mode == "weighted" else F.lit(1.0)
    return sizes.select("center_id", (F.lit(float(rate)) * share).alias("rate"))


def scale_leaves(trees: DataFrame, rates: DataFrame) -> DataFrame:
    """Leaf values times the rate of their center."""
    return trees.join(rates, "center_id").withColumn("value", F.col("value") * F.col("rate")).drop("rate")


def symmetric_merge(previous: DataFrame | None, current: DataFrame, sizes: DataFrame) -> DataFrame:
    """The previous model with weight 1 and each center's new trees with weight n_c / N (1/k without rows)."""
    whole = Window.partitionBy()
    total = F.sum("n_rows").over(whole)
    weight = F.when(total > 0, F.col("n_rows") / total).otherwise(1.0 / F.count(F.lit(1)).over(whole))
    added = current.drop("tree_weight").join(sizes.select("center_id", weight.alias("tree_weight")), "center_id")
    if previous is None:
        return added
    return previous.withColumn("tree_weight", F.coalesce("tree_weight", F.lit(1.0))).unionByName(added, allowMissingColumns=True)


def newest(trees: DataFrame, round_no: int) -> DataFrame:
    """Only the trees grown in one round."""
    return trees.where(F.col("round") == round_no)


def without_hessians(trees: DataFrame) -> DataFrame:
    """Trees as they may be shared: per-node hessian sums are left out."""
    return trees.drop("sum_hessian")


def tree_counts(trees: DataFrame) -> DataFrame:
    """Trees per (round, center)."""
    return trees.groupBy("round", "center_id").agg(F.count_distinct("tree_id").alias("n_trees"))


def weighted_loss(losses: DataFrame) -> DataFrame:
    """Row-weighted mean loss over the centers, per round."""
    return losses.groupBy("round").agg((F.sum(F.col("n_rows") * F.col("loss")) / F.sum("n_rows")).alias("loss"))


def weighted_metrics(metrics: DataFrame, keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """Row-weighted mean of each metric over the centers, per round (or other keys)."""
    return metrics.groupBy(*keys, "metric").agg(
        (F.sum(F.col("n_rows") * F.col("value")) / F.sum("n_rows")).alias("value")
    )


def encoder_bundle(trees: DataFrame) -> DataFrame:
    """Every center's ensemble in center order with the column each of its trees will fill."""
    return renumber(trees, ["center_id", "tree_id"]).withColumnRenamed("new_id", "column_no")
