"""One experiment end to end: prepare a table, train a model over rounds, and collect the history.

The history is metrics(run, round, phase, center_id, metric, value, n_rows) with the phases ``val``, ``test`` and
``not tuned`` for the shared model of each round, ``personalized`` for the centers' own models after their local step,
and ``local`` (round 0) for models trained without merging."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from centrum.operators import centers as ce, fairness, linear, metrics as met, prep, selection as fs, splits, targets, trees as tr
from centrum.operators.ordering import settle
from centrum.plans import rounds
from centrum.sources import readers

SOURCES = {
    "csv": readers.read_csv,
    "libsvm": readers.read_libsvm,
    "array": readers.array_source,
    "natural_centers": readers.natural_center_table,
    "named_centers": readers.named_center_table,
    "table": readers.without_ids,
    "features_and_targets": readers.features_with_target,
}


def source(name: str):
    """The reader of a source name."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known are {sorted(SOURCES)}")
    return SOURCES[name]


def prepare(
    data: DataFrame,
    key: str,
    target: str,
    numeric: list[str],
    text: list[str] = (),
    num_clients: int = 5,
    dirichlet_alpha: float | None = 1.0,
    partition_by_attribute: str | int | None = None,
    min_samples_per_class: int = 10,
    preprocessing: str = "reference",
    reference_method: str = "largest",
    normalization: str | None = "global",
    n_features: int | None = None,
    selection: str = "mutual_info",
    binary: bool = True,
    keep: list[str] = (),
    seed_distrib: int = 42,
    seed: int = 42,
) -> tuple[DataFrame, list[str]]:
    """(rows, feature names): rows are (row_key, center_id, label, split, features, kept columns).

    A table that has a ``center_id`` keeps it; otherwise centers are dealt out by the target or by an attribute.
    The parameters are fitted on all rows of each center and merged, training and test rows share them."""
    features = [*numeric, *text]
    data = data.withColumnRenamed(key, "row_key") if key != "row_key" else data
    data = targets.binarized(data, target) if binary else data.withColumn("label", F.col(target).cast("double"))
    data = data.select("row_key", "label", target, *features, *[c for c in (*keep, "center_id") if c in data.columns and c not in features])
    if "center_id" not in data.columns:
        by = ce.partition_column(features, partition_by_attribute) if partition_by_attribute is not None else target
        data = ce.dirichlet_centers(data, "row_key", by, num_clients, dirichlet_alpha, min_samples_per_class, seed_distrib)
    kept = [c for c in keep if c in data.columns]
    for c in kept:
        data = data.withColumn(f"_keep_{c}", F.col(c))
    rows = splits.stratified_split(data, "row_key", 0.2, seed).persist(StorageLevel.MEMORY_AND_DISK)
    params = prep.fit_and_merge(rows, list(numeric), list(text), preprocessing, reference_method, seed=seed_distrib)
    if n_features is not None and n_features < len(features):
        params.selected = chosen_features(rows, numeric, text, params, n_features, selection, preprocessing, reference_method, seed_distrib)
    names = [f for f in features if params.selected is None or f in params.selected]
    ready = prep.apply(rows, list(numeric), list(text), params, normalization)
    vector = F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in names]).alias("features")
    out = ready.select("row_key", "center_id", "label", "split", vector, *[F.col(f"_keep_{c}").alias(c) for c in kept])
    return out, names


def chosen_features(rows, numeric, text, params, n, selection, preprocessing, reference_method, seed) -> list[str]:
    """The features of the reference center, or those voted for by all centers."""
    names = [*numeric, *text]
    coded = prep.apply(rows, list(numeric), list(text), params, None)
    picked = settle(fs.select_features(coded, names, n, selection))
    sizes = settle(rows.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows")))
    if preprocessing == "reference":
        top = ce.reference_center(sizes, reference_method, seed)
        return [r["feature"] for r in picked.join(top.select("center_id"), "center_id", "left_semi").collect()]
    weights = prep.center_weights(sizes, "equal" in preprocessing)
    return [r["feature"] for r in fs.vote_features(picked, weights, n).collect()]


LINEAR = ("logistic_regression", "lsvc", "elastic_net")
MODELS = (*LINEAR, "random_forest", "balanced_random_forest", "xgb", "catboost", "xgblr")


#: Classes that a model may have; more are refused.
MOST_CLASSES = 100

#: Models that can learn more than two classes, and numbers.
CLASS_MODELS, NUMBER_MODELS = ("xgb",), ("xgb", "catboost")


def task_of(rows: DataFrame) -> str:
    """BINARY, MULTICLASS or REG, by the number of distinct labels."""
    return targets.task_types(rows, ["label"]).first()["task_type"]


def run(
    rows: DataFrame, width: int, model: str, num_rounds: int = 10, run_no: int = 1, seed: int = 42, task: str = "BINARY", attributes: list[str] = (), **settings
) -> DataFrame:
    """The history of one model on prepared rows. ``settings`` go to the model's rounds.

    ``task`` is BINARY, MULTICLASS or REG, or ``auto`` to choose by the labels. For each of ``attributes`` (kept columns) the
    history of a binary task holds the gaps between its groups as the metrics ``EOP <attribute>`` and ``EOD <attribute>``, in
    phase ``test`` of every round, for all rows of a center."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known are {MODELS}")
    task = task_of(rows) if task == "auto" else task
    if task != "BINARY":
        return _other_task(rows, width, model, num_rounds, run_no, seed, task, settings)
    rows = rows.select("row_key", "center_id", "label", "split", "features", *attributes)
    test = rows.where("split = 'test'")
    fit_rows = splits.stratified_split(rows.where("split = 'train'").drop("split"), "row_key", 0.2, seed + 1, held="val")
    data = fit_rows.unionByName(test).persist(StorageLevel.MEMORY_AND_DISK)
    train, judged = data.where("split = 'train'"), data.where("split <> 'train'")
    parts: list[DataFrame] = []

    def note(history: DataFrame, scored: DataFrame | None = None, round_no: int = 0) -> None:
        parts.append(settle(history))
        if attributes and scored is not None:
            parts.append(settle(gap_history(scored.where("split = 'test'"), list(attributes), round_no, run_no)))

    def clock(round_no: int, seconds: float) -> None:
        row = [(run_no, round_no, "fit", -1, "training_time", float(seconds), 0)]
        parts.append(data.sparkSession.createDataFrame(row, HISTORY))

    if model in LINEAR:
        linear_history(train, judged, width, model, num_rounds, run_no, note, clock, settings)
    elif model == "xgblr":
        encoded, _, n = rounds.encoded_rows(data, width, settings.pop("trees_per_center", 3), settings.pop("depth", 3))
        encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
        settings.setdefault("rate", 5.0)
        linear_history(
            encoded.where("split = 'train'"), encoded.where("split <> 'train'"), n, "logistic_regression", num_rounds, run_no, note, clock, settings
        )
        encoded.unpersist()
    elif model in ("xgb", "catboost"):
        symmetric = model == "catboost"
        alone = rounds.train_boosted(train, width, num_rounds=num_rounds, merged=False, symmetric=symmetric, **settings)
        note(rounds.phase_metrics(tr.score_boosted(judged, alone, own_center=True), "local", 0, run_no))
        total = 0.0
        for seconds, (round_no, grown) in rounds.timed(rounds.boosted_rounds(train, width, num_rounds, symmetric=symmetric, **settings)):
            total += seconds
            scored = tr.score_boosted(judged, grown)
            note(rounds.round_history(scored, round_no, run_no), scored, round_no)
            clock(round_no, total)
    else:
        total = 0.0
        fold = data.where("split <> 'test'").drop("split")
        loop = rounds.forest_rounds(fold, "row_key", num_rounds, balance=model.startswith("balanced"), seed=seed, **settings)
        for seconds, (round_no, forest, drawn) in rounds.timed(loop):
            total += seconds
            scored = tr.score_forest(drawn.where("split = 'val'").unionByName(test), forest)
            note(rounds.round_history(scored, round_no, run_no), scored, round_no)
            clock(round_no, total)
    data.unpersist()
    history = parts[0]
    for part in parts[1:]:
        history = history.unionByName(part)
    return history


def gap_history(scored: DataFrame, attributes: list[str], round_no: int, run_no: int = 1) -> DataFrame:
    """Gaps of the true and false positive rates between an attribute's two groups, as history rows of the test phase."""
    gaps = fairness.opportunity_gaps(fairness.group_rates(scored, attributes, ["center_id"]), ["center_id"])
    sizes = scored.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows"))
    each = F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("name"), F.col(m).alias("value")) for m in ("eop", "eod")])).alias("_g")
    long = gaps.select("center_id", "attribute", each).join(sizes, "center_id")
    name = F.concat_ws(" ", F.col("_g.name"), "attribute")
    return long.select(F.lit(run_no).alias("run"), F.lit(round_no).alias("round"), F.lit("test").alias("phase"), "center_id", name.alias("metric"), F.col("_g.value").alias("value"), "n_rows")


def _other_task(rows: DataFrame, width: int, model: str, num_rounds: int, run_no: int, seed: int, task: str, settings: dict) -> DataFrame:
    """Several classes (labels are numbered in order) or a number, by boosted rounds: local, validation and test metrics."""
    known = {"MULTICLASS": CLASS_MODELS, "REG": NUMBER_MODELS}
    if task not in known:
        raise ValueError(f"unknown task {task!r}; known are BINARY, MULTICLASS, REG and auto")
    if model not in known[task]:
        raise ValueError(f"{model!r} has no {task} form; {known[task]} have")
    data = splits.stratified_split(rows.where("split = 'train'").drop("split"), "row_key", 0.2, seed + 1, held="val") if task == "MULTICLASS" else splits.local_holdout(
        rows.where("split = 'train'").drop("split"), "row_key", 0.2, seed + 1
    )
    data = data.unionByName(rows.where("split = 'test'")).select("row_key", "center_id", "label", "split", "features")
    symmetric = model == "catboost"
    parts: list[DataFrame] = []
    if task == "MULTICLASS":
        labels = [r["label"] for r in data.select("label").distinct().orderBy("label").limit(MOST_CLASSES + 1).collect()]
        if len(labels) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes: every class takes a tree of its own in each round")
        number = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
        data = data.withColumn("label", number.cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
        train, judged = data.where("split = 'train'"), data.where("split <> 'train'")
        measure = lambda trees, k: met.multiclass_accuracy(rounds.predict_classes(judged, trees, len(labels)), ["center_id", "split"])
        loop = lambda merged: rounds.class_rounds(train, width, len(labels), num_rounds, merged=merged, **settings)
    else:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        train, judged = data.where("split = 'train'"), data.where("split <> 'train'")
        base = train.agg(F.avg("label")).first()[0] or 0.0
        scored = lambda trees, own: tr.add_margin(judged.withColumn("score", F.lit(float(base))), trees, "score", own_center=own)
        measure = lambda trees, k: met.regression_metrics(scored(trees, k == 0), ["center_id", "split"])
        loop = lambda merged: rounds.boosted_rounds(train, width, num_rounds, symmetric=symmetric, merged=merged, base=base, objective="squared", **settings)

    def note(wide: DataFrame, phase, round_no: int) -> None:
        if "n_rows" not in wide.columns:
            wide = wide.join(judged.groupBy("center_id", "split").agg(F.count(F.lit(1)).alias("n_rows")), ["center_id", "split"])
        long = met.long_metrics(wide, ["center_id", "split"], [c for c in wide.columns if c not in ("center_id", "split", "n_rows")])
        parts.append(settle(long.select(F.lit(run_no).alias("run"), F.lit(round_no).alias("round"), phase.alias("phase"), "center_id", "metric", "value", "n_rows")))

    if task == "REG":  # trees of single centers are told apart by their center; those of several classes aren't scored alone
        *_, (_, alone) = loop(False)
        note(measure(alone, 0).where("split = 'test'"), F.lit("local"), 0)
    for round_no, trees in loop(True):
        note(measure(trees, round_no), F.col("split"), round_no)
    data.unpersist()
    history = parts[0]
    for part in parts[1:]:
        history = history.unionByName(part)
    return history


#: Passes of the local baseline at most; it ends earlier when it has converged, and does not depend on the rounds.
LOCAL_STEPS = 1000

HISTORY = "run int, round int, phase string, center_id int, metric string, value double, n_rows bigint"


def linear_history(train, judged, width, algorithm, num_rounds, run_no, note, clock, settings) -> None:
    """Local baseline, then shared and personalised metrics of every round."""
    rate, local_steps = settings.get("rate", 1.0), settings.pop("local_steps", LOCAL_STEPS)
    score = lambda model: met.squash_margin(linear.score_linear(judged, model, width, probability=False))
    alone = rounds.local_linear(train, width, algorithm, steps=local_steps, rate=rate)
    note(rounds.phase_metrics(score(alone), "local", 0, run_no))
    total = 0.0
    for seconds, (round_no, shared, models) in rounds.timed(rounds.linear_rounds(train, width, algorithm, num_rounds, **settings)):
        total += seconds
        note(rounds.round_history(score(shared), round_no, run_no), score(shared), round_no)
        note(rounds.phase_metrics(score(models), "personalized", round_no, run_no))
        clock(round_no, total)
