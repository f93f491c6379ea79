"""Which centers take part in a round. k - ceil(p * k / 100) of the k centers stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from centrum.functions.columns import row_hash


def _first(stats: DataFrame, percent: float, order: list[Column]) -> DataFrame:
    k = F.count(F.lit(1)).over(Window.partitionBy())
    keep = k - F.ceil(F.lit(float(percent)) / 100 * k)
    place = F.row_number().over(Window.orderBy(*order))
    return stats.withColumn("place", place).withColumn("keep", keep).where("place <= keep").drop("place", "keep")


def alternate_by_cost(stats: DataFrame, percent: float, round_no: int, cost: str = "cost") -> DataFrame:
    """The cheapest centers in even rounds, the costliest in odd ones."""
    order = [F.asc(cost), F.asc("center_id")] if round_no % 2 == 0 else [F.desc(cost), F.desc("center_id")]
    return _first(stats, percent, order)


def cheap_every_third(stats: DataFrame, percent: float, round_no: int, cost: str = "cost", seed: int = 42) -> DataFrame:
    """The cheapest centers every third round, a random draw otherwise."""
    if round_no % 3 == 0:
        return _first(stats, percent, [F.asc(cost), F.asc("center_id")])
    return random_centers(stats, percent, round_no, seed)


def random_centers(stats: DataFrame, percent: float, round_no: int, seed: int = 42) -> DataFrame:
    """A random draw without replacement."""
    return _first(stats, percent, [row_hash("center_id", seed, round_no), F.asc("center_id")])


def alternate_by_rows(stats: DataFrame, percent: float, round_no: int) -> DataFrame:
    """The same alternation ranked by row count."""
    return alternate_by_cost(stats, percent, round_no, "n_rows")


def choose_centers(method: str | None, stats: DataFrame, percent: float, round_no: int, seed: int = 42) -> DataFrame:
    """Centers of one round by method name; everybody takes part in the first round or without a method, and an
    unknown name means ranking by row count."""
    if method in (None, "None") or round_no <= 1:
        return stats
    if method == "Fast_at_odd_rounds":
        return alternate_by_cost(stats, percent, round_no)
    if method == "Fast_every_three":
        return cheap_every_third(stats, percent, round_no, seed=seed)
    if method == "random_dropout":
        return random_centers(stats, percent, round_no, seed)
    return alternate_by_rows(stats, percent, round_no)
