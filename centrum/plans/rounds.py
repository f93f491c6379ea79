"""The round loop: choose centers, local step, merge, score. Only merged parameters come to the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from centrum.operators import dropout, forests, linear, merge, metrics as met, splits, trees as tr
from centrum.operators.binning import sketch_edges
from centrum.operators.ordering import join_params, settle
from centrum.session import cut_lineage
from centrum.sources.sinks import RoundStore


def check_settings(
    num_rounds: int, smoothing: str | None = None, strength: float = 0.5, dropout_method: str | None = None, percent: float = 0.0
) -> None:
    """Refuse settings outside their ranges."""
    if not isinstance(num_rounds, int) or num_rounds < 1:
        raise ValueError("num_rounds must be a positive whole number")
    if smoothing not in (None, "None", "EqualVoting", "SlowerQuartile", "SsupperQuartile"):
        raise ValueError("smoothing must be None, EqualVoting, SlowerQuartile or SsupperQuartile")
    if smoothing not in (None, "None") and not 0 <= strength <= 1:
        raise ValueError("strength must lie between 0 and 1")
    if dropout_method not in (None, "None") and not 0 <= percent < 100:
        raise ValueError("percent must lie in [0, 100)")


def center_stats(rows: DataFrame, cost: str | None = None) -> DataFrame:
    """Rows per center, with the cost that ranks centers in a drop-out (their row count unless a column is given)."""
    amount = F.sum(cost) if cost else F.count(F.lit(1))
    return settle(rows.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows"), amount.cast("double").alias("cost")))


def taking_part(rows: DataFrame, stats: DataFrame, method: str | None, percent: float, round_no: int, seed: int) -> DataFrame:
    """Rows of the centers chosen for a round."""
    if method in (None, "None") or round_no <= 1:
        return rows
    chosen = dropout.choose_centers(method, stats, percent, round_no, seed).select("center_id")
    return join_params(rows, chosen, "center_id", "left_semi")


def round_history(scored: DataFrame, round_no: int, run: int = 1) -> DataFrame:
    """Tuned, untuned and validation metrics of one round as history rows."""
    wide = met.tuned_metrics(scored, ["center_id"])
    return met.long_metrics(wide, ["center_id", "phase"]).select(
        F.lit(run).alias("run"), F.lit(round_no).alias("round"), "phase", "center_id", "metric", "value", "n_rows"
    )


def phase_metrics(scored: DataFrame, phase: str, round_no: int, run: int = 1) -> DataFrame:
    """Test metrics at the tuned threshold under another phase name (``local``, ``personalized``)."""
    return round_history(scored, round_no, run).where("phase = 'test'").withColumn("phase", F.lit(phase))


def _store(rows: DataFrame, path: str | None, settings: dict) -> RoundStore | None:
    """The store of a loop called with these arguments; the number of rounds may change from one call to the next."""
    free = ("rows", "store", "num_rounds", "cut_every")
    return RoundStore(rows.sparkSession, path, {k: v for k, v in settings.items() if k not in free}) if path else None


def linear_rounds(
    rows: DataFrame,
    width: int,
    algorithm: str = "logistic_regression",
    num_rounds: int = 10,
    rate: float = 1.0,
    steps: int = 1,
    mu: float = 0.0,
    smoothing: str | None = None,
    strength: float = 0.5,
    dropout_method: str | None = None,
    percent: float = 0.0,
    seed: int = 42,
    store: str | None = None,
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Yields (round, shared model, the centers' models) for training rows (center_id, features, label).

    With a folder as ``store`` each round's models are committed there, and a loop that was stopped goes on after the last
    committed round; if none is left, the last one is yielded again."""
    kept = _store(rows, store, locals())
    check_settings(num_rounds, smoothing, strength, dropout_method, percent)
    weighted = linear.balanced(rows) if algorithm != "regression" else rows.withColumn("weight", F.lit(1.0))
    weighted = weighted.select("center_id", "features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    stats = center_stats(weighted)
    shared, done = linear.shared_start(rows, width), min(kept.last(), num_rounds) if kept else 0
    if done:
        saved = kept.step(done)
        row = saved.where("center_id IS NULL").first()
        shared = linear.shared_start(rows, width, row["coef"], row["intercept"])
        if done == num_rounds:
            yield done, shared, settle(saved.where("center_id IS NOT NULL"))
    try:
        for round_no in range(done + 1, num_rounds + 1):
            part = taking_part(weighted, stats, dropout_method, percent, round_no, seed)
            models = settle(linear.local_round(part, shared, width, algorithm, rate, steps, mu))
            merged = merge.merge_linear(models, smoothing, strength, width)
            row = merged.first()
            if row is not None and row["intercept"] is not None:
                shared = linear.shared_start(rows, width, row["coef"], row["intercept"])
            if kept:
                kept.commit(models.unionByName(shared.select("coef", "intercept"), allowMissingColumns=True), round_no)
            yield round_no, shared, models
    finally:
        weighted.unpersist()


def train_linear(rows: DataFrame, width: int, **settings) -> tuple[DataFrame, DataFrame]:
    """(shared model, the centers' last models) after all rounds."""
    shared = models = None
    for _, shared, models in linear_rounds(rows, width, **settings):
        pass
    return shared, models


def local_linear(
    rows: DataFrame, width: int, algorithm: str = "logistic_regression", steps: int = 1000, rate: float = 1.0, tolerance: float = 1e-3
) -> DataFrame:
    """Every center trained alone: the same passes without merging, to convergence or ``steps`` passes."""
    weighted = linear.balanced(rows).select("center_id", "features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    models = settle(linear.local_round(weighted, linear.shared_start(rows, width), width, algorithm, rate, steps, tolerance=tolerance))
    weighted.unpersist()
    return models


def boosted_rounds(
    rows: DataFrame,
    width: int,
    num_rounds: int = 10,
    depth: int = 2,
    bins: int = 16,
    rate: float = 0.3,
    rate_mode: str = "weighted",
    train_method: str = "bagging",
    symmetric: bool = False,
    merged: bool = True,
    base: float = 0.0,
    objective: str = "logistic",
    scale_positive: float = 1.0,
    subsample: float = 1.0,
    key: str | None = None,
    min_gain: float = 0.0,
    dropout_method: str | None = None,
    percent: float = 0.0,
    seed: int = 42,
    cut_every: int = 10,
    parallel: int = 1,
    equal_width: bool = False,
    reg_alpha: float = 0.0,
    store: str | None = None,
) -> Iterator[tuple[int, DataFrame]]:
    """Yields (round, all trees so far). The margin of every row is kept and only moved by the newest trees; its
    lineage is cut every ``cut_every`` rounds. ``merged=False`` trains every center alone. Bins hold equal numbers of
    a center's rows, by sketches, unless they should be of ``equal_width``. ``parallel`` trees are grown in each round.

    With a folder as ``store`` each round's new trees are committed there. A loop that was stopped takes the margins from
    all committed trees and goes on after them; if no round is left, the last one is yielded again."""
    kept = _store(rows, store, locals())
    check_settings(num_rounds, None, 0.5, dropout_method, percent)
    if parallel > 1 and not key:
        raise ValueError("several trees a round need a key that tells rows apart")
    edges = settle(tr.bin_edges(rows, width)) if equal_width else sketch_edges(rows, width, bins)
    stats = center_stats(rows)
    mode = rate_mode if merged and not symmetric else "uniform"
    rates = settle(merge.step_sizes(stats, 1.0, mode))
    keep = ["center_id", "features", "label", *([key] if key else [])]
    current = tr.with_bins(rows.select(*keep), edges, width, bins).withColumn("margin", F.lit(float(base)))
    total = none = tr.no_trees(rows.sparkSession)
    done = min(kept.last(), num_rounds) if kept else 0
    if done:
        total = settle(kept.upto(done).to(none.schema))
        if done == num_rounds:
            yield done, total
            return
        current = tr.add_margin(current, total, own_center=not merged)
    current = current.persist(StorageLevel.MEMORY_AND_DISK)
    held = [current]
    for round_no in range(done + 1, num_rounds + 1):
        part = taking_part(current, stats, dropout_method, percent, round_no, seed)
        if subsample < 1.0 and key and parallel == 1:
            part = tr.row_subsample(part, key, subsample, seed, round_no)
        graded = tr.logistic_gradients(part, scale_positive=scale_positive) if objective == "logistic" else tr.squared_gradients(part)
        settings = {"bins": bins, "rate": rate, "min_gain": min_gain, "symmetric": symmetric, "round_no": round_no, "reg_alpha": reg_alpha}
        if parallel > 1:
            grown = tr.grow_parallel(graded, edges, width, depth, parallel, key, subsample, seed, **settings)
        else:
            grown = tr.grow(graded, edges, width, depth, **settings)
        # this round's rows are computed now, so those they came from can go
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        if merged and symmetric:
            grown = merge.symmetric_merge(None, grown, stats)
        elif merged and train_method != "bagging":
            grown = merge.largest_model(grown, stats)
        elif merged:
            grown = merge.scale_leaves(grown, rates)
        grown = settle(grown.to(none.schema))
        total = grown if round_no == 1 else settle(total.unionByName(grown))
        if kept:
            kept.commit(grown, round_no)
        yield round_no, total
        if round_no < num_rounds:
            current = tr.add_margin(current, grown, own_center=not merged)
            current = cut_lineage(current) if round_no % cut_every == 0 else current.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(current)
    for old in held:
        old.unpersist()


def train_boosted(rows: DataFrame, width: int, **settings) -> DataFrame:
    """All trees after the last round."""
    total = None
    for _, total in boosted_rounds(rows, width, **settings):
        pass
    return total


def forest_rounds(
    rows: DataFrame,
    key: str = "row_key",
    num_rounds: int = 1,
    tree_num: int = 100,
    depth: int = 10,
    balance: bool = False,
    combine: str = "weighted",
    keep_previous: bool = False,
    smoothing: str | None = None,
    strength: float = 0.5,
    dropout_method: str | None = None,
    percent: float = 0.0,
    seed: int = 42,
    store: str | None = None,
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Yields (round, merged trees, the round's training and validation rows). Every round draws its own stratified
    validation rows. With a folder as ``store`` merged trees are committed there after each round, and a loop that was
    stopped goes on after the last committed one; if none is left, that one is yielded again. ``combine``: ``weighted`` draws as many trees as one center has, by center weight; ``random``
    draws an equal number from every center; ``all`` keeps every tree."""
    kept = _store(rows, store, locals())
    check_settings(num_rounds, smoothing, strength, dropout_method, percent)
    done = min(kept.last(), num_rounds) if kept else 0
    stats, merged = center_stats(rows), settle(kept.step(done), max_rows=tr.NODES_PER_PASS) if done else None
    if done == num_rounds:
        yield done, merged, splits.stratified_split(rows, key, 0.2, (seed, done), held="val")
    for round_no in range(done + 1, num_rounds + 1):
        drawn = splits.stratified_split(rows, key, 0.2, (seed, round_no), held="val")
        part = taking_part(drawn.where("split = 'train'"), stats, dropout_method, percent, round_no, seed)
        trees = settle(forests.forest_round(part, key, tree_num, depth, balance, seed + round_no, round_no), max_rows=tr.NODES_PER_PASS)
        index = settle(trees.select("center_id", "tree_id").distinct())
        if combine == "all":
            chosen = merge.renumber(trees, ["center_id", "tree_id"]).drop("tree_id").withColumnRenamed("new_id", "tree_id")
        elif combine == "random":
            chosen = merge.take_trees(trees, merge.forest_random_draw(index, seed + round_no), ["center_id", "draw"])
        elif combine == "weighted":
            sizes = stats.join(index.select("center_id").distinct(), "center_id", "left_semi")
            plain = smoothing in (None, "None")
            weights = sizes.select("center_id", F.lit(1.0).alias("weight")) if plain else merge.smoothed_weights(sizes, smoothing, strength)
            draws = merge.forest_weighted_draw(index, weights, tree_num, seed + round_no)
            chosen = merge.take_trees(trees, draws.drop("weight"), ["draw"])
        else:
            raise ValueError("combine must be 'weighted', 'random' or 'all'")
        chosen = settle(chosen.select(*tr.no_trees(rows.sparkSession).columns), max_rows=tr.NODES_PER_PASS)
        merged = chosen if merged is None or not keep_previous else settle(merge.accumulate(merged, chosen), max_rows=tr.NODES_PER_PASS)
        if kept:
            kept.commit(merged, round_no)
        yield round_no, merged, drawn


def class_rounds(
    rows: DataFrame, width: int, classes: int, num_rounds: int = 10, depth: int = 2, bins: int = 16, rate: float = 0.3, rate_mode: str = "weighted",
    merged: bool = True, equal_width: bool = False, min_gain: float = 0.0, reg_alpha: float = 0.0, cut_every: int = 10,
) -> Iterator[tuple[int, DataFrame]]:
    """Softmax boosting: yields (round, all trees so far, with ``class_no``). Each round grows a tree for every center and class
    at once; labels are class numbers from 0. Margins of all classes move together, by the newest trees alone."""
    check_settings(num_rounds)
    edges = settle(tr.bin_edges(rows, width)) if equal_width else sketch_edges(rows, width, bins)
    rates = settle(merge.step_sizes(center_stats(rows), 1.0, rate_mode if merged else "uniform"))
    current = tr.with_bins(rows.select("center_id", "features", "label"), edges, width, bins)
    current = current.withColumn("margins", F.array_repeat(F.lit(0.0), classes)).persist(StorageLevel.MEMORY_AND_DISK)
    held, total = [current], None
    for round_no in range(1, num_rounds + 1):
        graded = tr.softmax_gradients(current, classes)
        grown = tr.grow_classes(graded, edges, width, depth, classes, round_no, bins=bins, rate=rate, min_gain=min_gain, reg_alpha=reg_alpha)
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        if merged:
            grown = merge.scale_leaves(grown, rates)
        grown = settle(grown.select(*tr.no_trees(rows.sparkSession).columns, "class_no"))
        total = grown if total is None else settle(total.unionByName(grown))
        yield round_no, total
        if round_no < num_rounds:
            current = tr.add_margins(current, grown, classes)
            current = cut_lineage(current) if round_no % cut_every == 0 else current.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(current)
    for old in held:
        old.unpersist()


def predict_classes(rows: DataFrame, trees: DataFrame, classes: int) -> DataFrame:
    """``prediction``: the number of the class with the largest margin (the first on ties), and ``scores``, their softmax shares."""
    scored = tr.add_margins(rows, trees, classes)
    top = F.array_max("margins")
    powers = F.transform("margins", lambda m: F.exp(m - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    place = (F.array_position("margins", top) - 1).cast("double")
    return scored.withColumn("prediction", place).withColumn("scores", F.transform(powers, lambda x: x / total)).drop("margins")


def one_vs_rest(rows: DataFrame, width: int, classes: list[float], **settings) -> DataFrame:
    """Multiclass ensembles: one binary ensemble per class, told apart by the column ``class_label``."""
    out = None
    for c in classes:
        part = train_boosted(rows.withColumn("label", (F.col("label") == c).cast("double")), width, **settings)
        part = part.withColumn("class_label", F.lit(float(c)))
        out = part if out is None else out.unionByName(part)
    return out


def predict_one_vs_rest(rows: DataFrame, ensembles: DataFrame, classes: list[float]) -> DataFrame:
    """The class whose ensemble gives the largest margin (first class on ties)."""
    names = []
    for i, c in enumerate(classes):
        rows = tr.add_margin(rows, ensembles.where(F.col("class_label") == c).drop("class_label"), f"_m{i}")
        names.append(f"_m{i}")
    margins = F.array(*names)
    place = F.array_position(margins, F.array_max(margins))
    table = F.array(*[F.lit(float(c)) for c in classes])
    return rows.withColumn("prediction", F.element_at(table, place.cast("int"))).drop(*names)


def encoded_rows(rows: DataFrame, width: int, trees_per_center: int = 5, depth: int = 3, key: str | None = None, **settings) -> tuple[DataFrame, DataFrame, int]:
    """(rows whose features are the outputs of every tree of every center, the trees, their number)."""
    ensembles = train_boosted(
        rows.where("split = 'train'") if "split" in rows.columns else rows,
        width, num_rounds=trees_per_center, depth=depth, merged=False, key=key, **settings,
    )
    n = ensembles.select("center_id", "tree_id").distinct().count()
    ordered = ensembles.withColumn("round", F.col("center_id"))
    encoded = tr.encode_trees(rows, ordered).withColumn("features", F.col("tree_out")).drop("tree_out")
    return encoded, ensembles, n


def pooled_baseline(rows: DataFrame, kind: str = "logistic", trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """A model on all rows without centers, with its error on the training and the test rows."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    data = rows.select("label", "split", array_to_vector("features").alias("_x")).persist(StorageLevel.MEMORY_AND_DISK)
    makers = {
        "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="label"),
        "boosted": lambda: GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed),
        "regression": lambda: GBTRegressor(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed),
    }
    model = makers[kind]().fit(data.where("split = 'train'"))
    scored = model.transform(data)
    error = F.avg((F.col("prediction") - F.col("label")) ** 2) if kind == "regression" else F.avg((F.col("prediction") != F.col("label")).cast("double"))
    out = settle(scored.groupBy("split").agg(error.alias("error"), F.count(F.lit(1)).alias("n_rows")))
    data.unpersist()
    return out


def custom_rounds(
    rows: DataFrame,
    partial: Callable[[pd.DataFrame, object], pd.DataFrame],
    schema: str,
    combine: Callable[[DataFrame], object],
    start: object,
    num_rounds: int,
) -> Iterator[tuple[int, object]]:
    """A user's own model: ``partial(batch, params)`` turns a batch of rows into partial results (one frame, all
    centers), ``combine(partials)`` reduces them with DataFrame operators and returns the next parameters (None
    keeps the old ones)."""
    params = start
    for round_no in range(1, num_rounds + 1):
        shared = rows.sparkSession.sparkContext.broadcast(params)

        def work(batches, shared=shared):
            for pdf in batches:
                if len(pdf):
                    yield partial(pdf, shared.value)

        merged = combine(rows.mapInPandas(work, schema))
        params = params if merged is None else merged
        yield round_no, params


def timed(rounds: Iterator) -> Iterator[tuple[float, tuple]]:
    """Each item of a round loop with the seconds it took."""
    begin = time.perf_counter()
    for item in rounds:
        yield time.perf_counter() - begin, item
        begin = time.perf_counter()

