"""Feature scores per center, top-k cuts and the vote over centers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from centrum.operators.ordering import exact_median, join_params
from centrum.operators.prep import long_values


def fill_for_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """Remaining nulls become the center's median, or 0 when there is none."""
    medians = exact_median(long_values(df, ["center_id"], features, "double"), ["center_id", "column"], "value")
    wide = medians.groupBy("center_id").pivot("column", features).agg(F.first("median"))
    wide = wide.select("center_id", *[F.col(c).alias(f"_m_{c}") for c in features])
    filled = join_params(df, wide, "center_id", "left")
    return filled.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) if c in features else F.col(c)
            for c in df.columns
        ]
    )


def anova_f(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One-way F of each feature over the label classes, per center, from n, sum and centred squares per class."""
    aggs = [
        F.struct(F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("m"), F.var_pop(F.col(c).cast("double")).alias("v")).alias(c)
        for c in features
    ]
    wide = df.groupBy("center_id", label).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features])
    classes = wide.select("center_id", F.explode(entries).alias("_e")).select("center_id", "_e.feature", "_e.s.*").where("n > 0")
    whole = Window.partitionBy("center_id", "feature")
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    sums = (
        classes.withColumn("_d", F.col("m") - grand)
        .groupBy("center_id", "feature")
        .agg(
            F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("between"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
        )
    )
    spread = F.col("within") / (F.col("n") - F.col("k"))
    score = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (spread > 0), (F.col("between") / (F.col("k") - 1)) / spread)
    return sums.select("center_id", "feature", score.alias("score"))


def binned_mutual_info(df: DataFrame, features: list[str], bins: int = 16, label: str = "label") -> DataFrame:
    """Mutual information of each feature with the label, per center, on equal-width bins between the center's
    smallest and largest value (in nats)."""
    edges = df.groupBy("center_id").agg(
        *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in features],
        *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in features],
    )
    with_edges = join_params(df, edges, "center_id")
    entries = []
    for c in features:
        x, lo, hi = F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        place = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
        entries.append(F.struct(F.lit(c).alias("feature"), place.cast("int").alias("bin")))
    cells = (
        with_edges.select("center_id", label, F.explode(F.array(*entries)).alias("_e"))
        .groupBy("center_id", "_e.feature", "_e.bin", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    base = ["center_id", "feature"]
    total = F.sum("n").over(Window.partitionBy(*base))
    by_bin = F.sum("n").over(Window.partitionBy(*base, "bin"))
    by_label = F.sum("n").over(Window.partitionBy(*base, label))
    terms = cells.select(*base, (F.col("n") / total * F.ln(F.col("n") * total / (by_bin * by_label))).alias("t"))
    return terms.groupBy(*base).agg(F.sum("t").alias("score"))


def forest_importance(df: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Random-forest importances per center: the forests of all centers are grown together, and each tree's gains are
    added up by feature. Null features count as the lowest values."""
    from centrum.operators.forests import forest_nodes, importances

    rows = df.select(key, "center_id", F.col(label).alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("features"))
    return importances(forest_nodes(rows, key, len(features), trees, depth, seed=seed), features)


def rank_features(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Place of each feature by falling score (name on ties); ``k`` keeps the first k, and a ``k`` that is not
    below the number of features keeps all."""
    place = F.row_number().over(Window.partitionBy("center_id").orderBy(F.desc_nulls_last("score"), "feature"))
    ranked = scores.withColumn("place", place)
    return ranked if k is None else ranked.where(F.col("place") <= k)


SCORERS = {"mutual_info": binned_mutual_info, "f_classif": anova_f, "random_forest": forest_importance}


def select_features(df: DataFrame, features: list[str], k: int | None, method: str = "mutual_info", label: str = "label") -> DataFrame:
    """The k best features of each center (all features when k is not below their number)."""
    if method not in SCORERS:
        raise ValueError(f"method must be one of {sorted(SCORERS)}")
    return rank_features(SCORERS[method](fill_for_scores(df, features), features, label=label), k)


def vote_features(selected: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """Every center gives its weight to each feature it selected; the n with the most weight stay."""
    votes = selected.join(weights, "center_id").groupBy("feature").agg(F.sum("weight").alias("votes"))
    return votes.orderBy(F.desc(F.round("votes", 9)), "feature").limit(n)
