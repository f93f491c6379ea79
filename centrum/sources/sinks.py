"""Writers for results, round histories and model checkpoints."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_center_results(wide: DataFrame, path: str, fmt: str = "csv") -> None:
    """The per-center result table as CSV (with header) or Parquet."""
    writer = wide.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def append_history(metrics: DataFrame, path: str) -> None:
    """Append metric rows to the history, values as doubles, one folder per run."""
    metrics.withColumn("value", F.col("value").cast("double")).write.mode("append").partitionBy("run").parquet(path)


def write_model_round(model: DataFrame, path: str, round_no: int) -> None:
    """Checkpoint of a merged model: rewriting a round replaces that round only."""
    model.write.mode("overwrite").parquet(f"{path.rstrip('/')}/round={round_no}")


def read_model_rounds(spark: SparkSession, path: str) -> DataFrame:
    """All checkpointed rounds of a model, with the round as a column."""
    return spark.read.parquet(path)


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class RoundStore:
    """The rounds of one training, each committed once, so that a stopped loop goes on after the last one.

    A round's rows are written first and noted in a log afterwards. A round that isn't in the log doesn't count: it is
    computed and written again. The log keeps the settings; a loop with other ones is refused."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True, default=str)

    def last(self) -> int:
        """The last committed round, 0 if there is none."""
        log = read_if_any(self.spark, f"{self.path}/log")
        if log is None:
            return 0
        if not log.where(F.col("settings") != self.settings).isEmpty():
            raise ValueError(f"the rounds in {self.path} were computed with other settings")
        return log.agg(F.max("step")).first()[0] or 0

    def commit(self, rows: DataFrame, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/step={step}")
        note = self.spark.createDataFrame([(step, self.settings)], "step int, settings string")
        note.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def step(self, step: int) -> DataFrame:
        """The rows of one committed round."""
        return self.spark.read.parquet(f"{self.path}/rows/step={step}")

    def upto(self, step: int) -> DataFrame:
        """The rows of all rounds up to one, put together."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("step") <= step).drop("step")
