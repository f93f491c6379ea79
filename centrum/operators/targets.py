"""What the target is, and how it becomes a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centrum.operators.ordering import exact_median


def more_than_two_values(df: DataFrame, target: str) -> bool:
    """Whether any value lies strictly between the smallest and the largest; no distinct values are gathered."""
    ends = df.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return False
    return not df.where((F.col(target) > F.lit(ends["lo"])) & (F.col(target) < F.lit(ends["hi"]))).select(target).limit(1).isEmpty()


def binarized(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """1 above the median and 0 below when there are more than two values; otherwise the target as it is."""
    if not more_than_two_values(df, target):
        return df.withColumn(out, F.col(target).cast("double"))
    middle = exact_median(df, [], target).first()["median"]
    return df.withColumn(out, (F.col(target) > F.lit(middle)).cast("double"))


def task_kind(n_labels):
    """BINARY for two labels, MULTICLASS for 3 to 99, REG for other numbers of labels."""
    return F.when(n_labels == 2, "BINARY").when((n_labels > 2) & (n_labels < 100), "MULTICLASS").otherwise("REG")


def task_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and task type of each column, from the distinct (column, value) pairs."""
    entries = [F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("v")) for c in columns]
    distinct = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.source", "_e.v").distinct()
    counts = distinct.groupBy("source").agg(F.count("v").alias("n_labels"))
    return counts.withColumn("task_type", task_kind(F.col("n_labels")))
