"""Metrics by groups of protected attributes, and the gaps between two groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from centrum.functions.columns import clean_key, group_letter, ratio
from centrum.operators.metrics import all_metrics, confusion


def present_attributes(df: DataFrame, attributes: list[str | int], features: list[str] | None = None) -> list[str]:
    """The attributes that exist, by name or by position among the features; others are skipped."""
    names = features if features is not None else df.columns
    found = []
    for a in attributes:
        if isinstance(a, int) and not isinstance(a, bool):
            if 0 <= a < len(names):
                found.append(names[a])
        elif a in df.columns:
            found.append(a)
    return found


def by_attribute(df: DataFrame, attributes: list[str], keys: list[str]) -> DataFrame:
    """One row per (row, attribute) with the group value, so any number of attributes costs one aggregate."""
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes])
    return df.select(*keys, "score", "label", F.explode(entries).alias("_a")).select(
        *keys, "score", "label", clean_key(F.col("_a.attribute")).alias("attribute"), "_a.group"
    )


def lettered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups named A, B, ... in sorted order inside (keys, attribute)."""
    place = F.dense_rank().over(Window.partitionBy(*keys, "attribute").orderBy("group")) - 1
    return groups.withColumn("letter", group_letter(place))


def group_metrics(df: DataFrame, attributes: list[str | int], keys: list[str], threshold: float | str = 0.5, features: list[str] | None = None) -> DataFrame:
    """Every metric for every group of every attribute."""
    long = by_attribute(df, present_attributes(df, attributes, features), keys)
    return lettered(all_metrics(long, [*keys, "attribute", "group"], threshold), keys)


def group_rates(df: DataFrame, attributes: list[str], keys: list[str], threshold: float = 0.5) -> DataFrame:
    """True and false positive rate of every group, 0 where undefined."""
    counts = confusion(by_attribute(df, attributes, keys), [*keys, "attribute", "group"], threshold)
    return counts.select(
        *keys,
        "attribute",
        "group",
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def opportunity_gaps(rates: DataFrame, keys: list[str]) -> DataFrame:
    """EOP (gap of the true positive rates) and EOD (the larger of both gaps), only where there are two groups."""
    gap = lambda c: F.max(c) - F.min(c)
    gaps = rates.groupBy(*keys, "attribute").agg(
        gap("tpr").alias("eop"), F.greatest(gap("tpr"), gap("fpr")).alias("eod"), F.count(F.lit(1)).alias("_n")
    )
    return gaps.where("_n = 2").drop("_n")
