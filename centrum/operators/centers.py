"""Assign rows to centers, and describe the centers."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from centrum.functions.columns import HASH_RANGE, row_hash, whole_div
from centrum.operators.ordering import deal, join_params, running_sums, same_keys, settle


def _chunk_starts(parts: int):
    """Bounds of near-equal contiguous chunks: the first n % parts of them hold one row more."""
    n, c = F.col("n_group"), F.sequence(F.lit(1), F.lit(parts - 1))
    start = lambda i: (i * whole_div(n, parts) + F.least(i.cast("bigint"), n % parts)).cast("bigint")
    none = F.array().cast("array<bigint>")
    return lambda sizes: sizes.withColumn("bounds", F.transform(c, start) if parts > 1 else none)


def iid_centers(df: DataFrame, key: str, centers: int, seed: int = 42) -> DataFrame:
    """Shuffle by hash, then near-equal contiguous chunks."""
    return deal(df, [], key, (seed,), _chunk_starts(centers), "center_id")


def equal_split(df: DataFrame, key: str, centers: int, seed: int = 0) -> DataFrame:
    """Equal random parts; the last part takes the remainder."""
    size = F.greatest(whole_div(F.col("n_group"), centers), F.lit(1))
    starts = [(size * c).cast("bigint") for c in range(1, centers)]
    none = F.array().cast("array<bigint>")
    return deal(df, [], key, (seed,), lambda sizes: sizes.withColumn("bounds", F.array(*starts) if starts else none), "center_id")


def kfold(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Shuffled folds in column ``fold``."""
    return deal(df, [], key, (seed,), _chunk_starts(folds), "fold")


def kfold_centers(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Center k holds the training side of fold k, that is the rows of all other folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda c: c != F.col("fold"))
    return kfold(df, key, folds, seed).withColumn("center_id", F.explode(others))


def draw_shares(value, centers: int, alpha: float, seed: int = 42) -> np.ndarray:
    """The Dirichlet draw of one class; it follows from the class value alone."""
    return np.random.default_rng([seed, zlib.crc32(str(value).encode())]).dirichlet([alpha] * centers)


def dirichlet_shares(classes: DataFrame, class_col: str, centers: int, alpha: float, seed: int = 42) -> DataFrame:
    """One Dirichlet draw per class: rows (class, center_id, share). Seeded by the class value, so the draw does
    not depend on how the classes are partitioned."""

    def draw(batches):
        for pdf in batches:
            parts = []
            for value in pdf[class_col]:
                parts.append(pd.DataFrame({class_col: value, "center_id": np.arange(centers), "share": draw_shares(value, centers, alpha, seed)}))
            if parts:
                yield pd.concat(parts)

    dtype = dict(classes.dtypes)[class_col]
    return classes.select(class_col).mapInPandas(draw, f"{class_col} {dtype}, center_id int, share double")


def slice_counts(
    sizes: DataFrame, shares: DataFrame, class_col: str, centers: int, min_per_class: int = 10, seed: int = 42
) -> DataFrame:
    """Whole row counts per (class, center) that add up to the class size, as slices [lo, hi) of its shuffled rows.

    A share is cut down to whole rows and lifted to the floor ``min(min_per_class, n // centers)``. Rows left
    over go to centers drawn by hash; an excess is taken from the largest centers first, never below the floor."""
    n = F.col("n_class")
    floor = F.least(F.lit(min_per_class), whole_div(n, centers))
    first = same_keys(shares, sizes.select(class_col, n), [class_col]).withColumn("_floor", floor)
    first = first.withColumn("_c", F.greatest(F.floor(F.col("share") * n), F.col("_floor")))
    per_class = Window.partitionBy(class_col)
    first = first.withColumn("_diff", n - F.sum("_c").over(per_class))
    # what may be taken from the centers that come before, largest first
    spare = F.col("_c") - F.col("_floor")
    largest = per_class.orderBy(F.desc("_c"), "center_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(spare).over(largest), F.lit(0))
    cut = F.greatest(F.lit(0), F.least(spare, -F.col("_diff") - taken))
    drawn = (
        first.where((F.col("center_id") == 0) & (F.col("_diff") > 0))
        .select(class_col, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_diff"))).alias("_draw"))
        .select(class_col, (row_hash(F.col("_draw"), seed, F.col(class_col)) % centers).cast("int").alias("center_id"))
        .groupBy(class_col, "center_id")
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    counted = same_keys(first.withColumn("_cut", cut), drawn, [class_col, "center_id"], "left").withColumn(
        "n_rows", (F.col("_c") - F.col("_cut") + F.coalesce("_extra", F.lit(0))).cast("bigint")
    )
    upto = per_class.orderBy("center_id").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("hi", F.sum("n_rows").over(upto)).select(
        class_col, "center_id", "n_rows", (F.col("hi") - F.col("n_rows")).alias("lo"), "hi", "n_class"
    )


def _check_shares(sizes: DataFrame, shares: DataFrame, class_col: str) -> None:
    """An error for classes without shares, or with shares that don't sum to 1: their rows would be lost."""
    sums = shares.groupBy(class_col).agg(F.sum("share").alias("_sum"))
    wrong = same_keys(sizes, sums, [class_col], "left").where(F.col("_sum").isNull() | (F.abs(F.col("_sum") - 1) > 1e-6))
    found = [r[class_col] for r in wrong.select(class_col).limit(5).collect()]
    if found:
        raise ValueError(f"shares of these classes of {class_col} are absent or do not sum to 1: {found}")


def dirichlet_centers(
    df: DataFrame,
    key: str,
    class_col: str,
    centers: int,
    alpha: float | None = 1.0,
    min_per_class: int = 10,
    seed: int = 42,
    shares: DataFrame | None = None,
) -> DataFrame:
    """Label-skewed centers: every class is shuffled and dealt out in consecutive slices whose sizes follow a
    Dirichlet draw. ``class_col`` may be the label or any attribute. No ``alpha`` (or one <= 0) gives IID centers.
    ``shares`` replaces the draw and must hold every class, with shares that sum to 1. Null is a class of its own: each
    row comes back in one center."""
    if shares is None and (not alpha or alpha <= 0):
        return iid_centers(df, key, centers, seed)
    sizes = settle(df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_class")))
    if shares is None:
        shares = dirichlet_shares(sizes, class_col, centers, alpha, seed)
    else:
        _check_shares(sizes, shares, class_col)
    slices = slice_counts(sizes, shares, class_col, centers, min_per_class, seed).drop("n_rows")
    listed = F.sort_array(F.collect_list(F.struct("center_id", "hi")))
    listed = settle(slices.groupBy(class_col).agg(listed.alias("_s")).select(class_col, F.col("_s.center_id").alias("_ids"), F.slice("_s.hi", 1, F.size("_s") - 1).alias("bounds")))
    dealt = deal(df, [class_col], key, (seed,), lambda sizes: same_keys(sizes, listed.drop("_ids"), [class_col]), "_slice")
    named = join_params(dealt, listed.drop("bounds"), class_col, null_safe=True)
    return named.withColumn("center_id", F.get("_ids", F.col("_slice"))).drop("_ids", "_slice")


def partition_column(columns: list[str], attribute: str | int) -> str:
    """The column to partition by, given by name or by position; wrong ones are refused."""
    if isinstance(attribute, int):
        if not 0 <= attribute < len(columns):
            raise ValueError(f"attribute index {attribute} is outside the {len(columns)} feature columns")
        return columns[attribute]
    if attribute not in columns:
        raise ValueError(f"attribute column {attribute!r} does not exist")
    return attribute


def attribute_centers(df: DataFrame, key: str, features: list[str], attribute: str | int, centers: int, **kwargs) -> DataFrame:
    """Centers skewed on a feature column instead of the label."""
    return dirichlet_centers(df, key, partition_column(features, attribute), centers, **kwargs)


def natural_code_centers(df: DataFrame, code_col: str) -> DataFrame:
    """Centers from a code column: the sorted distinct codes are numbered from 0; rows without a code are the last center."""
    placed = running_sums(df.select(code_col).distinct(), [F.asc_nulls_last(code_col)], center=F.lit(1))
    numbered = placed.select(code_col, F.col("center_before").cast("int").alias("center_id"))
    return join_params(df, numbered, code_col, null_safe=True)


def named_centers(df: DataFrame, name_col: str, names: list[str]) -> DataFrame:
    """Centers from a name column and a fixed list of names; rows of other names are left out."""
    table = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{name_col} string, center_id int")
    return join_params(df, table, name_col)


def select_center(df: DataFrame, center_id: int | None = None) -> DataFrame:
    """The rows of one center, or all rows without an id; a center without rows is an error."""
    if center_id is None:
        return df
    chosen = df.where(F.col("center_id") == center_id)
    if chosen.isEmpty():
        raise ValueError(f"center {center_id} has no rows")
    return chosen


def center_sizes(df: DataFrame, by_label: bool = False) -> DataFrame:
    """Rows per center, or per center and label."""
    keys = ["center_id", "label"] if by_label else ["center_id"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def reference_center(sizes: DataFrame, method: str = "largest", seed: int = 42) -> DataFrame:
    """The one center (row of the size table) whose parameters are used: the largest, smallest id first on ties,
    or the one with the smallest hash."""
    if method == "largest":
        order = [F.desc("n_rows"), F.asc("center_id")]
    elif method == "random":
        order = [row_hash("center_id", seed), F.asc("center_id")]
    else:
        raise ValueError("method must be 'largest' or 'random'")
    return sizes.where(F.col("n_rows") > 0).orderBy(*order).limit(1)


def class_shares(df: DataFrame, split_col: str = "split", label: str = "label") -> DataFrame:
    """Share of each label inside each split."""
    counts = df.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(split_col)))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable sample: rows whose hash falls below the fraction."""
    if fraction >= 1.0:
        return df
    return df.where(row_hash(key, seed) < int(fraction * HASH_RANGE))
