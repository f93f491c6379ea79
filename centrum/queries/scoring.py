"""Metrics and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from centrum.operators import fairness, linear, metrics as met
from centrum.plans import rounds, views as V
from centrum.queries.models import BALANCED, OWN_ROUNDS, start
from centrum.queries.registry import finished, query, rounded

T = 0.1
CONF = f"{V.SCORED}, c AS (SELECT center_id, {V.sql_confusion('0.1e0')} FROM scored GROUP BY 1)"


def sql_auroc(source: str, keys: str, name: str = "area") -> str:
    """Exact AUROC by midranks."""
    return f"""{name}r AS (SELECT {keys}, label, score, rank() OVER (PARTITION BY {keys} ORDER BY score)
        + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2e0 AS mid FROM {source}),
      {name} AS (SELECT {keys}, CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN
        (coalesce(sum(mid) FILTER (label = 1), 0) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2e0)
        / (cast(count(*) FILTER (label = 1) AS double) * count(*) FILTER (label = 0)) ELSE 0 END AS auroc FROM {name}r GROUP BY ALL)"""


def scored(spark, folder):
    return V.scored_rows(spark, folder)


@query("met_1_confusion", f"WITH {CONF} SELECT * FROM c")
def confusion(spark, folder):
    return met.confusion(scored(spark, folder), ["center_id"], T)


RATE5 = ", ".join(f"round({m}, 6) AS {m}" for m in ["accuracy", "precision", "recall", "specificity", "f1"])


@query("met_2_rates", f"WITH {CONF}, r AS (SELECT center_id, {V.sql_rates()} FROM c) SELECT center_id, {RATE5} FROM r")
def rates(spark, folder):
    out = met.with_rates(met.confusion(scored(spark, folder), ["center_id"], T))
    return out.select("center_id", *[rounded(m) for m in ["accuracy", "precision", "recall", "specificity", "f1"]])


@query(
    "met_3_balanced_accuracy",
    f"WITH {CONF}, r AS (SELECT center_id, {V.sql_rates()} FROM c) SELECT center_id, round(balanced_accuracy, 6) AS balanced_accuracy FROM r",
)
def balanced_accuracy(spark, folder):
    out = met.with_rates(met.confusion(scored(spark, folder), ["center_id"], T))
    return out.select("center_id", rounded("balanced_accuracy"))


@query("met_4_auroc", f"WITH {V.SCORED}, {sql_auroc('scored', 'center_id')} SELECT center_id, round(auroc, 6) AS auroc FROM area")
def auroc(spark, folder):
    return met.auroc(scored(spark, folder), ["center_id"]).select("center_id", rounded("auroc"))


@query("met_5_mse", f"WITH {V.SCORED} SELECT center_id, round(avg((label - score) * (label - score)), 6) AS mse FROM scored GROUP BY 1")
def mse(spark, folder):
    return met.mean_squared_error(scored(spark, folder), ["center_id"]).select("center_id", rounded("mse"))


@query(
    "met_6_class_counts",
    f"WITH {V.SCORED} SELECT center_id, count(*) FILTER (label = 1) AS n_positives, count(*) FILTER (label = 0) AS n_negatives FROM scored GROUP BY 1",
)
def class_counts(spark, folder):
    return met.class_counts(scored(spark, folder), ["center_id"])


ALL = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "auroc", "n_positives", "n_negatives"]


def sql_all(source: str, keys: list[str], cut: str, name: str = "w") -> str:
    """Every metric by key."""
    ks = ", ".join(f'"{k}"' for k in keys)
    on = " AND ".join(f'x."{k}" = y."{k}"' for k in keys)
    return f"""{name}c AS (SELECT {ks}, {V.sql_confusion(cut)} FROM {source} GROUP BY ALL), {sql_auroc(source, ks, name + 'a')},
      {name} AS (SELECT {', '.join(f'x."{k}"' for k in keys)}, tp+fp+tn+fn AS n_rows, {V.sql_rates()}, y.auroc,
        cast(tp+fn AS double) AS n_positives, cast(fp+tn AS double) AS n_negatives FROM {name}c x JOIN {name}a y ON {on})"""


def sql_long(name: str, keys: list[str]) -> str:
    ks = ", ".join(f'"{k}"' for k in keys)
    rounds_ = ", ".join(f"round({m}, 6) AS {m}" for m in ALL)
    return f"SELECT {ks}, metric, value, n_rows FROM (SELECT {ks}, n_rows, {rounds_} FROM {name}) UNPIVOT (value FOR metric IN ({', '.join(ALL)}))"


def long(wide, keys):
    return met.long_metrics(wide, keys).withColumn("value", F.round("value", 6))


@query("met_7_all_metrics", f"WITH {V.SCORED}, {sql_all('scored', ['center_id'], '0.1e0')} {sql_long('w', ['center_id'])}")
def all_metrics(spark, folder):
    return long(met.all_metrics(scored(spark, folder), ["center_id"], T), ["center_id"])


def sql_best(source: str, name: str = "best") -> str:
    """The best threshold by trying all 101 of them."""
    return f"""{name}t AS (SELECT center_id, t, {V.sql_confusion('t')} FROM {source}, (SELECT i * 0.01e0 AS t FROM range(101) r(i)) GROUP BY ALL),
      {name}r AS (SELECT center_id, t, {V.sql_rates()} FROM {name}t),
      {name} AS (SELECT center_id, CASE WHEN balanced_accuracy > 0 THEN t ELSE 0.5e0 END AS threshold, balanced_accuracy AS best_value FROM
        (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY balanced_accuracy DESC, t) AS rn FROM {name}r) WHERE rn = 1)"""


@query(
    "met_8_best_threshold",
    f"WITH {V.SCORED}, {sql_best('scored')} SELECT center_id, round(threshold, 6) AS threshold, round(best_value, 6) AS best_value FROM best",
)
def best_threshold(spark, folder):
    return met.best_threshold(scored(spark, folder), ["center_id"]).select("center_id", rounded("threshold"), rounded("best_value"))


TUNED_KEYS = ["center_id", "phase"]


@query(
    "met_9_tuned_metrics",
    f"""WITH {V.SCORED}, v AS (SELECT * FROM scored WHERE split = 'val'), {sql_best('v')},
        ph AS (SELECT s.center_id, 'val' AS phase, score, label, coalesce(threshold, 0.5e0) AS cut FROM scored s LEFT JOIN best USING (center_id) WHERE split = 'val' UNION ALL
               SELECT s.center_id, 'test', score, label, coalesce(threshold, 0.5e0) FROM scored s LEFT JOIN best USING (center_id) WHERE split = 'test' UNION ALL
               SELECT center_id, 'not tuned', score, label, 0.5e0 FROM scored WHERE split = 'test'),
        {sql_all('ph', TUNED_KEYS, 'cut')} {sql_long('w', TUNED_KEYS)}""",
)
def tuned_metrics(spark, folder):
    return long(met.tuned_metrics(scored(spark, folder), ["center_id"]), TUNED_KEYS)


@query(
    "met_10_merge",
    f"""WITH {V.HISTORY} SELECT run, round, phase, metric, round(avg(value), 6) AS value,
        array_to_string(list(cast(round(value * 1000) AS bigint) ORDER BY center_id), ',') AS per_center,
        array_to_string(list(n_rows ORDER BY center_id), ',') AS per_center_rows FROM history GROUP BY ALL""",
)
def merge_metrics(spark, folder):
    out = met.merge_metrics(V.round_history(spark, folder), ["run", "round", "phase"])
    text = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return out.select(
        "run", "round", "phase", "metric", rounded("value"),
        text("per_center", lambda v: F.round(v * 1000).cast("bigint").cast("string")),
        text("per_center_rows", lambda v: v.cast("string")),
    )


@query(
    "met_11_hard_prediction_measures",
    f"""WITH {V.SCORED}, h AS (SELECT event_id % 40 AS part, {V.sql_confusion('0.3e0')} FROM scored GROUP BY 1),
        m AS (SELECT part, tp/cast(nullif(tp+fn,0) AS double) AS sens, tn/cast(nullif(tn+fp,0) AS double) AS spec,
              tp/cast(nullif(tp+fp,0) AS double) AS prec, (tp+tn)/cast(tp+tn+fp+fn AS double) AS acc FROM h)
        SELECT part, round(acc, 6) AS accuracy, round(spec, 6) AS specificity, round(sens, 6) AS sensitivity, round((sens + spec) / 2, 6) AS balanced_accuracy,
        round(prec, 6) AS precision, CASE WHEN prec + sens > 0 THEN round(2 * prec * sens / (prec + sens), 6) END AS f1 FROM m""",
)
def hard_measures(spark, folder):
    rows = scored(spark, folder).withColumn("part", F.col("event_id") % 40)
    out = met.strict_rates(met.confusion(rows, ["part"], 0.3))
    return out.select("part", *[rounded(m) for m in ["accuracy", "specificity", "sensitivity", "balanced_accuracy", "precision", "f1"]])


@query("met_12_personalized")
def personalized(spark, folder):
    from centrum.operators.splits import one_pass_train_val_test

    rows = one_pass_train_val_test(V.planted_features(spark, folder), "row_key").persist()
    _, models = rounds.train_linear(rows.where("split = 'train'"), V.WIDTH, num_rounds=OWN_ROUNDS, rate=3.0)
    scored_by_own = linear.score_linear(rows.where("split <> 'train'"), models, V.WIDTH)
    return finished(rounds.phase_metrics(scored_by_own, "personalized", OWN_ROUNDS).withColumn("value", F.round("value", 4)), rows)


@query(
    "met_13_training_loss",
    f"""WITH {BALANCED} SELECT center_id, round(sum(weight * (ln(1 + exp(-abs(m))) + greatest(m, 0) - label * m)) / sum(weight), 6) AS loss,
        round(sum(CASE WHEN (m > 0) = (label = 1) THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM x GROUP BY 1""",
)
def training_loss(spark, folder):
    rows = linear.balanced(V.planted_features(spark, folder))
    sums = linear.gradient_sums(rows, start(rows), V.WIDTH, "log")
    w = F.col("weight_sum")
    return sums.select("center_id", rounded("loss", of=F.col("loss_sum") / w), rounded("accuracy", of=F.col("hit_sum") / w))


@query(
    "met_14_multiclass",
    """WITH e AS (SELECT cast(vec_id % 5 AS integer) AS center_id, cast(label AS double) AS label, cast((label + vec_id % 3) % 10 AS double) AS p FROM embeddings)
       SELECT center_id, round(avg(cast(p = label AS double)), 6) AS accuracy, round(1 - avg(cast(p = label AS double)), 6) AS loss FROM e GROUP BY 1""",
)
def multiclass(spark, folder):
    rows = V.array_rows(spark, folder).withColumn("prediction", (F.col("label") + F.col("vec_id") % 3) % 10)
    return met.multiclass_accuracy(rows, ["center_id"]).select("center_id", rounded("accuracy"), rounded("loss"))


@query(
    "met_15_accumulated_time",
    """WITH t AS (SELECT cast(event_id % 5 AS integer) AS run, cast((event_id // 5) % 10 AS integer) AS round, sum(value) AS v FROM events GROUP BY ALL)
       SELECT run, round, round(v, 4) AS round_time, round(sum(v) OVER (PARTITION BY run ORDER BY round), 4) AS training_time FROM t""",
)
def accumulated_time(spark, folder):
    e = V.table(spark, folder, "events")
    run, no = (F.col("event_id") % 5).cast("int"), (F.floor(F.col("event_id") / 5) % 10).cast("int")
    times = e.groupBy(run.alias("run"), no.alias("round")).agg(F.sum("value").alias("round_time"))
    return met.accumulated_time(times).select("run", "round", rounded("round_time", 4), rounded("training_time", 4))


P = "greatest(1e-15, least(1 - 1e-15, CASE WHEN label = 1 THEN score ELSE 1 - score END))"


@query(
    "scr_4_losses",
    f"""WITH {V.SCORED}, {sql_auroc('scored', 'center_id')}
        SELECT 'log_loss' AS kind, center_id, round(avg(-ln({P})), 6) AS loss, count(*) AS n_rows FROM scored GROUP BY ALL UNION ALL
        SELECT 'mse', center_id, round(avg((label - score) * (label - score)), 6), count(*) FROM scored GROUP BY ALL UNION ALL
        SELECT 'constant', center_id, 1, count(*) FROM scored GROUP BY ALL UNION ALL
        SELECT 'one_minus_auroc', center_id, round(1 - any_value(auroc), 6), count(*) FROM scored JOIN area USING (center_id) GROUP BY ALL""",
)
def losses(spark, folder):
    out = None
    for kind in ("log_loss", "mse", "constant", "one_minus_auroc"):
        part = met.loss_of(scored(spark, folder), ["center_id"], kind).select(F.lit(kind).alias("kind"), "center_id", rounded("loss"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


GROUPS = f"""{V.SCORED}, lg AS (SELECT center_id, score, label, 'parity' AS attribute, parity AS "group" FROM scored UNION ALL
  SELECT center_id, score, label, 'user_tier', "user tier" FROM scored)"""
GKEYS = ["center_id", "attribute", "group"]


@query(
    "fair_1_attribute_lookup",
    f"""WITH {V.SCORED} SELECT 'user_tier' AS attribute, "user tier" AS "group", count(*) AS n FROM scored GROUP BY ALL UNION ALL
        SELECT 'parity', parity, count(*) FROM scored GROUP BY ALL""",
)
def attribute_lookup(spark, folder):
    rows = scored(spark, folder)
    found = fairness.present_attributes(rows, ["user tier", "absent", 1, 7], ["score", "parity"])
    return fairness.by_attribute(rows, found, []).groupBy("attribute", "group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fair_2_group_metrics",
    f"""WITH {GROUPS}, {sql_all('lg', GKEYS, '0.1e0')}, lt AS (SELECT *, chr(cast(64 + dense_rank() OVER (PARTITION BY center_id, attribute ORDER BY "group") AS integer)) AS letter FROM w)
        {sql_long('lt', [*GKEYS, 'letter'])}""",
)
def group_metrics(spark, folder):
    wide = fairness.group_metrics(scored(spark, folder), ["parity", "user tier"], ["center_id"], T)
    return long(wide, [*GKEYS, "letter"])


RATES = f"""{GROUPS}, gc AS (SELECT center_id, attribute, "group", {V.sql_confusion('0.1e0')} FROM lg GROUP BY ALL),
  gr AS (SELECT center_id, attribute, "group", CASE WHEN tp+fn > 0 THEN tp/cast(tp+fn AS double) ELSE 0 END AS tpr,
         CASE WHEN fp+tn > 0 THEN fp/cast(fp+tn AS double) ELSE 0 END AS fpr FROM gc)"""


@query("fair_3_group_rates", f"""WITH {RATES} SELECT center_id, "group", round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, attribute FROM gr""")
def group_rates(spark, folder):
    out = fairness.group_rates(scored(spark, folder), ["parity", "user tier"], ["center_id"], T)
    return out.select("center_id", "attribute", "group", rounded("tpr"), rounded("fpr"))


GAPS = """SELECT center_id, attribute, round(max(tpr) - min(tpr), 6) AS eop, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS eod
  FROM gr GROUP BY ALL HAVING count(*) = 2"""


@query("fair_4_eop_eod", f"WITH {RATES} {GAPS}")
def eop_eod(spark, folder):
    rates_ = fairness.group_rates(scored(spark, folder), ["parity", "user tier"], ["center_id"], T)
    return fairness.opportunity_gaps(rates_, ["center_id"]).select("center_id", "attribute", rounded("eop"), rounded("eod"))


@query("fair_5_several_attributes", f"""WITH {RATES} SELECT center_id, attribute, "group", round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM gr""")
def several_attributes(spark, folder):
    out = fairness.group_rates(scored(spark, folder), ["parity", "user tier"], ["center_id"], T)
    return out.select("center_id", "attribute", "group", rounded("tpr"), rounded("fpr"))
