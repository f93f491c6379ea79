"""Linear models, their merge, and the choice of centers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from centrum.operators import dropout, linear, merge, metrics as met
from centrum.operators.prep import center_weights
from centrum.plans import rounds, views as V
from centrum.queries.registry import finished, query, rounded

# Rounds that are checkpointed, rounds before the centers' own models are judged, passes of the local baseline.
CHECKPOINTS, OWN_ROUNDS, LOCAL_PASSES = 10, 10, 10
# A fixed model that the single steps start from.
START, BIAS, RATE = [0.1, -0.2, 0.3, 0.05], 0.1, 0.5
MARGIN = " + ".join([f"{BIAS}e0", *[f"{w}e0 * f{i}" for i, w in enumerate(START)]])
WEIGHTS = """cw AS (SELECT center_id, label, sum(count(*)) OVER (PARTITION BY center_id) / (2e0 * count(*)) AS weight FROM planted GROUP BY center_id, label)"""
BALANCED = f"{V.PLANTED}, {WEIGHTS}, x AS (SELECT p.*, weight, {MARGIN} AS m FROM planted p JOIN cw ON cw.center_id = p.center_id AND cw.label = p.label)"


def sql_gradient(slope: str) -> str:
    parts = ", ".join(f"sum(weight * ({slope}) * f{i}) AS g{i}" for i in range(4))
    return f"{BALANCED}, g AS (SELECT center_id, count(*) AS n, {parts}, sum(weight * ({slope})) AS gb FROM x GROUP BY 1)"


LOG_SLOPE = "1e0 / (1e0 + exp(-m)) - label"
HINGE_SLOPE = "CASE WHEN (2*label-1) * m < 1 THEN -(2*label-1) ELSE 0 END"


def sql_steps(coef) -> str:
    """(center_id, pos, value) rows from a rule for the coefficients; the intercept takes a plain step."""
    rows = [f"SELECT center_id, n, {i} AS pos, {coef(i)} AS v FROM g" for i in range(4)]
    rows.append(f"SELECT center_id, n, -1 AS pos, {BIAS}e0 - {RATE}e0 * gb / n AS v FROM g")
    return " UNION ALL ".join(rows)


def logistic_rule(i: int) -> str:
    return f"{START[i]}e0 - {RATE}e0 * (g{i} / n + {START[i]}e0 / n)"


def hinge_rule(i: int) -> str:
    return f"{START[i]}e0 - {RATE}e0 * (g{i} / n + 1e-4 * {START[i]}e0)"


def elastic_rule(i: int) -> str:
    v = f"({START[i]}e0 - {RATE}e0 * g{i} / n)"
    return f"sign({v}) * greatest(abs({v}) - {RATE}e0 * 1e-4 * 0.5e0, 0) / (1 + {RATE}e0 * 1e-4 * 0.5e0)"


def start(rows):
    return linear.shared_start(rows, V.WIDTH, START, BIAS)


def step(spark, folder, algorithm: str, mu: float = 0.0):
    rows = linear.balanced(V.planted_features(spark, folder))
    return linear.local_round(rows, start(rows), V.WIDTH, algorithm, RATE, 1, mu)


def as_rows(models):
    return merge.parameter_rows(models).select("center_id", "pos", rounded("value"))


SELECT_STEP = "SELECT center_id, pos, round(v, 6) AS value FROM s"


@query("trn_1_logistic_step", f"WITH {sql_gradient(LOG_SLOPE)}, s AS ({sql_steps(logistic_rule)}) {SELECT_STEP}")
def logistic_step(spark, folder):
    return as_rows(step(spark, folder, "logistic_regression"))


@query("trn_2_hinge_step", f"WITH {sql_gradient(HINGE_SLOPE)}, s AS ({sql_steps(hinge_rule)}) {SELECT_STEP}")
def hinge_step(spark, folder):
    return as_rows(step(spark, folder, "lsvc"))


@query("trn_3_elastic_step", f"WITH {sql_gradient(LOG_SLOPE)}, s AS ({sql_steps(elastic_rule)}) {SELECT_STEP}")
def elastic_step(spark, folder):
    return as_rows(step(spark, folder, "elastic_net"))


@query("trn_4_class_weights", f"WITH {V.PLANTED}, {WEIGHTS} SELECT center_id, label, round(weight, 6) AS weight FROM cw")
def class_weights(spark, folder):
    return linear.class_weights(V.planted_rows(spark, folder)).select("center_id", "label", rounded("weight"))


@query(
    "trn_6_proximal_step",
    f"""WITH {sql_gradient(LOG_SLOPE)}, s AS ({sql_steps(elastic_rule)}),
        w(pos, w0) AS (VALUES {', '.join(f'({i}, {w}e0)' for i, w in enumerate(START))}, (-1, {BIAS}e0))
        SELECT center_id, pos, round(v - 0.02e0 * (v - w0), 6) AS value FROM s JOIN w USING (pos)""",
)
def proximal_step(spark, folder):
    return as_rows(step(spark, folder, "elastic_net", mu=0.02))


@query("trn_12_local_baseline")
def local_baseline(spark, folder):
    from centrum.operators.splits import one_pass_train_val_test

    rows = one_pass_train_val_test(V.planted_features(spark, folder), "row_key").persist()
    models = rounds.local_linear(rows.where("split = 'train'"), V.WIDTH, steps=LOCAL_PASSES, rate=3.0, tolerance=0.0)
    scored = linear.score_linear(rows.where("split <> 'train'"), models, V.WIDTH)
    return finished(rounds.phase_metrics(scored, "local", 0).withColumn("value", F.round("value", 4)), rows)


@query("trn_13_pooled_baseline")
def pooled_baseline(spark, folder):
    from centrum.operators.splits import one_pass_train_val_test

    rows = one_pass_train_val_test(V.planted_features(spark, folder), "row_key")
    return rounds.pooled_baseline(rows, "logistic").select("split", rounded("error", 3), "n_rows")


SCORE = f"1e0 / (1e0 + exp(-({MARGIN})))"


@query(
    "scr_1_linear_score",
    f"WITH {V.PLANTED} SELECT row_key, round({SCORE}, 9) AS score, round({MARGIN}, 9) AS margin FROM planted",
)
def linear_score(spark, folder):
    rows = V.planted_features(spark, folder)
    scored = linear.score_linear(rows, start(rows), V.WIDTH)
    scored = linear.score_linear(scored, start(rows), V.WIDTH, probability=False, out="margin")
    return scored.select("row_key", rounded("score", 9), rounded("margin", 9))


MODELS = f"{sql_gradient(LOG_SLOPE)}, s AS ({sql_steps(logistic_rule)})"


@query("fed_1_fedavg", f"WITH {MODELS} SELECT pos, round(sum(n * v) / sum(n), 6) AS value FROM s GROUP BY 1")
def fedavg(spark, folder):
    return merge.fedavg_parameters(step(spark, folder, "logistic_regression")).select("pos", rounded("value"))


WEIGHT_D = f"{V.STATS}, d AS (SELECT center_id, n_rows / cast(sum(n_rows) OVER () AS double) AS d, 1e0 / count(*) OVER () AS h FROM stats)"


def weight_query(name: str, sql: str, method, strength: float = 0.5):
    @query(name, f"WITH {WEIGHT_D} SELECT center_id, round({sql}, 6) AS weight FROM d")
    def weights(spark, folder):
        return merge.smoothed_weights(V.center_stats(spark, folder), method, strength).select("center_id", rounded("weight"))


weight_query("fed_2_equal_voting", "d * 0.7e0 + h * 0.3e0", "EqualVoting", 0.3)
weight_query("fed_3_lower_quartile", "(d + (d + h) / 2) / 2", "SlowerQuartile")
weight_query("fed_4_upper_quartile", "(h + (d + h) / 2) / 2", "SsupperQuartile")
weight_query("fed_5_homogeneous", "h", None)


@query(
    "fed_6_smoothed_merge",
    f"""WITH {MODELS}, d AS (SELECT center_id, n / cast(sum(n) OVER () AS double) AS d, 1e0 / count(*) OVER () AS h FROM g)
        SELECT pos, round(sum((d * 0.7e0 + h * 0.3e0) * v), 6) AS value FROM s JOIN d USING (center_id) GROUP BY 1""",
)
def smoothed_merge(spark, folder):
    models = step(spark, folder, "logistic_regression")
    weights = merge.smoothed_weights(models.select("center_id", "n_rows"), "EqualVoting", 0.3)
    return merge.weighted_parameters(models, weights).select("pos", rounded("value"))


LOSSES = f"""{V.SCORED}, l AS (SELECT cast(event_id % 10 AS integer) AS round, center_id, count(*) AS n_rows,
  avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN label = 1 THEN score ELSE 1 - score END)))) AS loss FROM scored GROUP BY ALL)"""


def round_losses(spark, folder):
    rows = V.scored_rows(spark, folder).withColumn("round", (F.col("event_id") % 10).cast("int"))
    return met.log_loss(rows, ["round", "center_id"])


@query("fed_17_weighted_loss", f"WITH {LOSSES} SELECT round, round(sum(n_rows * loss) / sum(n_rows), 6) AS loss FROM l GROUP BY 1")
def weighted_loss(spark, folder):
    return merge.weighted_loss(round_losses(spark, folder)).select("round", rounded("loss"))


@query(
    "fed_18_weighted_metrics",
    f"""WITH {V.HISTORY} SELECT run, round, metric, round(sum(n_rows * value) / sum(n_rows), 6) AS value FROM history
        WHERE phase = 'test' GROUP BY ALL""",
)
def weighted_metrics(spark, folder):
    test = V.round_history(spark, folder).where("phase = 'test'")
    return merge.weighted_metrics(test, ("run", "round")).select("run", "round", "metric", rounded("value"))


@query("fed_19_linear_rounds")
def linear_rounds(spark, folder):
    from centrum.operators.splits import one_pass_train_val_test

    rows = one_pass_train_val_test(V.planted_features(spark, folder), "row_key").persist()
    shared, _ = rounds.train_linear(rows.where("split = 'train'"), V.WIDTH, num_rounds=5, rate=3.0, dropout_method="random_dropout", percent=30.0)
    history = rounds.round_history(linear.score_linear(rows.where("split <> 'train'"), shared, V.WIDTH), 5)
    return finished(history.where("metric IN ('auroc', 'balanced_accuracy')").withColumn("value", F.round("value", 4)), rows)


@query("fed_21_custom_model", f"WITH {V.PLANTED} SELECT center_id, round(avg(f1), 6) AS centroid, count(*) AS n FROM planted GROUP BY 1")
def custom_model(spark, folder):
    """A user's model through the hook: the mean of one feature per center, from partial sums per batch."""

    def partial(pdf: pd.DataFrame, params) -> pd.DataFrame:
        x = pdf.assign(s=pdf["features"].str[1], n=1)
        return x.groupby("center_id", as_index=False)[["s", "n"]].sum()

    def combine(partials):
        return partials.groupBy("center_id").agg((F.sum("s") / F.sum("n")).alias("centroid"), F.sum("n").alias("n")).collect()

    rows = V.planted_features(spark, folder)
    for _, centers in rounds.custom_rounds(rows, partial, "center_id int, s double, n bigint", combine, None, 1):
        pass
    return spark.createDataFrame(centers, "center_id int, centroid double, n bigint").select("center_id", rounded("centroid"), "n")


def sel_sql(order: str, percent: float, tag: str) -> str:
    return f"""SELECT '{tag}' AS draw, center_id, n_rows FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place,
        count(*) OVER () - ceil({percent}e0 / 100 * count(*) OVER ()) AS keep FROM stats) WHERE place <= keep"""


def tagged(parts: dict):
    out = None
    for tag, part in parts.items():
        part = part.select(F.lit(tag).alias("draw"), "center_id", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sel_1_alternate_by_cost",
    f"WITH {V.STATS} {sel_sql('cost, center_id', 35.0, 'even')} UNION ALL {sel_sql('cost DESC, center_id DESC', 35.0, 'odd')}",
)
def alternate_by_cost(spark, folder):
    s = V.center_stats(spark, folder)
    return tagged({"even": dropout.alternate_by_cost(s, 35.0, 2), "odd": dropout.alternate_by_cost(s, 35.0, 3)})


@query(
    "sel_2_cheap_every_third",
    f"WITH {V.STATS} {sel_sql('cost, center_id', 35.0, 'third')} UNION ALL {sel_sql(V.sql_hash('center_id', 42, 4) + ', center_id', 35.0, 'other')}",
)
def every_third(spark, folder):
    s = V.center_stats(spark, folder)
    return tagged({"third": dropout.cheap_every_third(s, 35.0, 3), "other": dropout.cheap_every_third(s, 35.0, 4)})


@query("sel_3_random", f"WITH {V.STATS} {sel_sql(V.sql_hash('center_id', 42, 5) + ', center_id', 20.0, 'random')}")
def random_centers(spark, folder):
    return tagged({"random": dropout.random_centers(V.center_stats(spark, folder), 20.0, 5)})


@query(
    "sel_4_alternate_by_rows",
    f"WITH {V.STATS} {sel_sql('n_rows, center_id', 50.0, 'even')} UNION ALL {sel_sql('n_rows DESC, center_id DESC', 50.0, 'odd')}",
)
def alternate_by_rows(spark, folder):
    s = V.center_stats(spark, folder)
    return tagged({"even": dropout.choose_centers("other", s, 50.0, 2), "odd": dropout.choose_centers("other", s, 50.0, 3)})


@query(
    "pooled_moments",
    f"""WITH {V.PLANTED}, l AS (SELECT center_id, feature, v FROM (SELECT center_id, l_quantity, l_extendedprice, l_discount, l_tax FROM planted)
          UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))),
        c AS (SELECT center_id, feature, count(*) AS n, avg(v) AS m, coalesce(nullif(stddev_samp(v), 0), 1) AS s FROM l GROUP BY ALL),
        w AS (SELECT *, n / cast(sum(n) OVER (PARTITION BY feature) AS double) AS w FROM c),
        g AS (SELECT feature, sum(w * m) AS g FROM w GROUP BY 1)
        SELECT w.feature AS "column", round(any_value(g), 6) AS mean, round(sqrt(sum(w*s*s) + sum(w*(m-g)*(m-g))), 6) AS std
        FROM w JOIN g ON g.feature = w.feature GROUP BY 1""",
)
def pooled_moments(spark, folder):
    """Pooled mean and deviation of every feature over the centers, from per-center moments only."""
    from centrum.operators import prep

    rows = V.planted_rows(spark, folder)
    moments = prep.numeric_moments(rows, V.NUMERIC)
    sizes = moments.groupBy("center_id").agg(F.max("n_rows").alias("n_rows"))
    usable = moments.select("center_id", "column", "mean", prep.usable_std(F.col("std")).alias("std"))
    return prep.merge_moments(usable, center_weights(sizes)).select("column", rounded("mean"), rounded("std"))
