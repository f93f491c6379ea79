"""Cut points of features from mergeable sketches: bins of equal mass, whatever the spread of the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from centrum.operators.ordering import join_params, settle

#: Rank error of a sketch is at most one in so many rows.
ACCURACY = 10_000
#: Parts that weights are summed in; a weighted cut is off by at most one part's weight.
PARTS = 1024


def sketch_edges(df: DataFrame, width: int, bins: int = 32, weight: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(center_id, cuts): for every feature at most ``bins`` - 1 rising cut points; a value's bin is the number of cuts up to it.

    One pass keeps a quantile sketch for each center and feature, merged over tasks, so a center may hold any share of the rows.
    Cuts split the rows (or the sum of ``weight``) into equal parts. A feature of at most ``bins`` distinct
    values in a center is cut at each of them, so nothing is lost there. Nulls and NaN take no part; a feature without
    values has no cut. With weights a second pass sums them between the cuts of a finer sketch.
    """
    x = [F.nanvl(F.col("features")[i], F.lit(None).cast("double")) for i in range(width)]
    parts = bins if weight is None else PARTS
    shares = F.array(*[F.lit(k / parts) for k in range(parts)])
    sketched = df.groupBy("center_id").agg(
        F.array(*[F.percentile_approx(v, shares, accuracy) for v in x]).alias("at"), F.array(*[F.approx_count_distinct(v) for v in x]).alias("kinds")
    )
    sketched = settle(sketched)
    # collected only where the sketch saw few kinds, so a set has a bound; the rest gives null and is dropped
    few = [F.when(F.col("kinds")[i] <= 2 * bins, x[i]) for i in range(width)]
    sets = join_params(df.select("center_id", "features"), sketched.select("center_id", "kinds"), "center_id")
    exact = sets.groupBy("center_id").agg(F.array(*[F.sort_array(F.collect_set(v)) for v in few]).alias("values"))
    if weight is not None:
        sketched = sketched.drop("at").join(weighted_cuts(df, width, sketched, bins, weight), "center_id")
    rising = lambda a: F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<double>"))))
    inner = lambda a: F.filter(rising(a), lambda v: v > F.array_min(a))
    cuts = [
        F.when(F.size(F.col("values")[i]).between(1, bins), F.slice(F.col("values")[i], 2, bins)).otherwise(inner(F.col("at")[i]))
        for i in range(width)
    ]
    cuts = [F.coalesce(c, F.array().cast("array<double>")) for c in cuts]
    return settle(sketched.join(exact, "center_id").select("center_id", F.array(*cuts).alias("cuts")))


def weighted_cuts(df: DataFrame, width: int, sketched: DataFrame, bins: int, weight: str) -> DataFrame:
    """(center_id, at): values that split each feature's sum of weights into ``bins`` parts."""
    joined = join_params(df.select("center_id", "features", F.col(weight).alias("_w")), sketched.select("center_id", "at"), "center_id")
    long = joined.select("center_id", "_w", "at", F.posexplode("features").alias("feature", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    own = F.col("at")[F.col("feature")]
    low = F.element_at(F.filter(own, lambda c: c <= F.col("v")), -1)
    summed = long.groupBy("center_id", "feature", low.alias("v")).agg(F.sum("_w").alias("w"))
    whole = Window.partitionBy("center_id", "feature")
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("w").over(upto) - F.col("w")
    placed = summed.select("center_id", "feature", "v", F.floor(before / F.sum("w").over(whole) * bins).alias("part"))
    first = placed.groupBy("center_id", "feature", "part").agg(F.min("v").alias("v"))
    lists = first.groupBy("center_id", "feature").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    pairs = lists.groupBy("center_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "vs"))).alias("m"))
    none = F.array().cast("array<double>")
    return pairs.select("center_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), none) for i in range(width)]).alias("at"))


def bin_of(value: Column, cuts: Column) -> Column:
    """The number of cut points up to a value; 0 for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(F.size(F.filter(cuts, lambda c: c <= value)))


def with_cut_bins(df: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Bin numbers of all features in one array."""
    joined = join_params(df, edges, "center_id")
    bins = F.array(*[bin_of(F.col("features")[i], F.col("cuts")[i]).cast("int") for i in range(width)])
    return joined.withColumn("bins", bins).drop("cuts")
