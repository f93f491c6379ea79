"""Train, validation and test splits inside each center."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from centrum.operators.ordering import deal


def _bounds(*cuts: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Bounds of a group from its size."""
    return lambda sizes: sizes.withColumn("bounds", F.array(*[c(F.col("n_group")).cast("bigint") for c in cuts]))


def _named(df: DataFrame, groups: list[str], key: str, salt: tuple, cuts: list, names: list[str]) -> DataFrame:
    """Rows with ``split``: the name of their slice."""
    slices = F.array(*map(F.lit, names))
    return deal(df, groups, key, salt, _bounds(*cuts), "_slice").withColumn("split", F.get(slices, F.col("_slice"))).drop("_slice")


def _kept_back(ratio: float) -> Callable[[Column], Column]:
    """Rows held out of a group: one always stays, so a group of one row has no held-out rows."""
    return lambda n: F.least(F.round(n * F.lit(float(ratio))), n - 1)


def local_holdout(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """``val`` for int(n * ratio) rows of each center, ``train`` for the rest."""
    return _named(df, ["center_id"], key, (seed,), [lambda n: F.floor(n * F.lit(float(ratio)))], ["val", "train"])


def stratified_split(
    df: DataFrame, key: str, ratio: float = 0.2, seed=42, label: str = "label", held: str = "test", extra: list[str] | None = None
) -> DataFrame:
    """Hold out ``ratio`` of every (center, label); a center with at most one row holds nothing out."""
    salt = seed if isinstance(seed, tuple) else (seed,)
    return _named(df, [*(extra or []), "center_id", label], key, salt, [_kept_back(ratio)], [held, "train"])


def train_val_test(df: DataFrame, key: str, seed: int = 42, ratio: float = 0.2, label: str = "label") -> DataFrame:
    """Test rows first, then validation rows out of the training rows in an order of their own (64/16/20 by default).

    The second order is taken by (split, center, label), so the test rows are a group of their own, of which nothing is cut."""
    first = stratified_split(df, key, ratio, seed, label)
    cut = lambda sizes: sizes.withColumn("bounds", F.array(F.when(F.col("split") == "train", _kept_back(ratio)(F.col("n_group"))).otherwise(0).cast("bigint")))
    second = deal(first, ["split", "center_id", label], key, (seed + 1,), cut, "_slice")
    return second.withColumn("split", F.when((F.col("split") == "train") & (F.col("_slice") == 0), "val").otherwise(F.col("split"))).drop("_slice")


def one_pass_train_val_test(df: DataFrame, key: str, seed: int = 42, ratio: float = 0.2, label: str = "label") -> DataFrame:
    """The same 64/16/20 proportions from one order: validation rows follow the test rows."""
    test = lambda n: F.round(n * F.lit(float(ratio)))
    val = lambda n: test(n) + F.round((n - test(n)) * F.lit(float(ratio)))
    return _named(df, ["center_id", label], key, (seed,), [test, val], ["test", "val", "train"])


def shuffle_splits(df: DataFrame, key: str, n_splits: int, ratio: float = 0.2, seed: int = 42, label: str = "label") -> DataFrame:
    """Independent stratified (train, val) draws, numbered in ``split_no``."""
    copies = df.withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return stratified_split(copies, key, ratio, (seed, F.col("split_no")), label, "val", ["split_no"])
