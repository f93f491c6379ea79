"""Readers: each returns one DataFrame with features and label on the same row."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from centrum.functions.columns import recode_negative, whole_div
from centrum.operators.centers import hash_sample, named_centers, natural_code_centers
from centrum.operators.ordering import ordered_position


def feature_list(features: list[str] | str | None) -> list[str] | None:
    """A list, a comma-separated string or nothing."""
    if isinstance(features, str):
        features = [name.strip() for name in features.split(",") if name.strip()]
    return list(features) if features else None


def read_csv(
    spark: SparkSession,
    path: str,
    target: str | None,
    features: list[str] | str | None = None,
    schema: T.StructType | str | None = None,
    file_name: str | None = None,
) -> DataFrame:
    """CSV with a header; only the feature columns and the target are parsed. ``file_name`` names a file below
    ``path``. Give ``schema`` to spare the inference pass."""
    if not target:
        raise ValueError("the target column must be named")
    if file_name:
        path = f"{path.rstrip('/')}/{file_name}"
    reader = spark.read.option("header", True)
    data = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return select_features(data, target, features)


def select_features(data: DataFrame, target: str, features: list[str] | str | None = None) -> DataFrame:
    """Feature columns followed by the target; missing ones are refused."""
    wanted = feature_list(features)
    if target not in data.columns:
        raise ValueError(f"target column {target!r} does not exist")
    missing = [name for name in wanted or [] if name not in data.columns]
    if missing:
        raise ValueError(f"feature columns do not exist: {missing}")
    chosen = [c for c in (wanted or data.columns) if c != target]
    return data.select(*chosen, target)


def without_ids(data: DataFrame, id_col: str, outcome: str) -> DataFrame:
    """Drop the id, and hand the outcome on as ``label``."""
    return data.drop(id_col).withColumnRenamed(outcome, "label")


def natural_center_table(data: DataFrame, code_col: str, id_col: str, outcome: str) -> DataFrame:
    """A table whose centers are numeric site codes."""
    return without_ids(natural_code_centers(data, code_col).drop(code_col), id_col, outcome)


def named_center_table(data: DataFrame, name_col: str, names: list[str], outcome: str) -> DataFrame:
    """A table whose centers are named in a column."""
    return named_centers(data, name_col, names).drop(name_col).withColumnRenamed(outcome, "label")


def read_libsvm(spark: SparkSession, path: str, n_features: int, binary: bool = True) -> DataFrame:
    """label index:value text with 1-based indices, as a dense array; label -1 becomes 0 in binary tasks."""
    data = spark.read.format("libsvm").option("numFeatures", n_features).load(path)
    label = recode_negative(F.col("label")) if binary else F.col("label")
    return data.select(label.alias("label"), vector_to_array("features").alias("features"))


def array_source(
    data: DataFrame, array_col: str, row_col: str, cut: int, block: int = 65536
) -> DataFrame:
    """Rows of one array whose last element is the label. The first ``cut`` rows in row order are training rows,
    all others are test rows."""
    rows = data.select(
        row_col,
        F.slice(array_col, 1, F.size(array_col) - 1).alias("features"),
        F.element_at(array_col, -1).alias("label"),
    )
    ranked = ordered_position(rows, [], whole_div(F.col(row_col), block), [row_col])
    return ranked.withColumn("split", F.when(F.col("pos") <= cut, "train").otherwise("test")).drop("pos", "n_group")


def features_with_target(features: DataFrame, targets: DataFrame, key: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """A feature table and its target table joined on the row key, sampled by hash when ``fraction`` < 1."""
    return hash_sample(features, key, fraction, seed).join(targets, key)
