"""Summaries of round histories, and experiment grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from centrum.operators import results as rs
from centrum.plans import views as V
from centrum.queries.registry import query, rounded

BEST = f"""{V.HISTORY}, vm AS (SELECT run, round, avg(value) AS v FROM history WHERE phase = 'val' AND metric = 'balanced_accuracy' GROUP BY ALL),
  best AS (SELECT run, round AS best_round, v AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(v, 12) DESC, round) AS rn FROM vm) WHERE rn = 1),
  fr AS (SELECT run, min(round) AS first FROM history GROUP BY 1),
  chosen AS (SELECT h.* FROM history h JOIN best b ON b.run = h.run JOIN fr ON fr.run = h.run
    WHERE h.round = CASE WHEN phase = 'local' THEN first ELSE best_round END)"""
SUMMARY = f"""{BEST}, summ AS (SELECT phase, metric, center_id, avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(value) END AS std, count(*) AS n_runs FROM chosen GROUP BY ALL)"""
WEIGHTS = """wt AS (SELECT center_id, arg_min(n_rows, (run, metric)) AS n_rows FROM chosen WHERE phase = 'test' GROUP BY 1)"""


def history(spark, folder):
    return V.round_history(spark, folder)


def chosen(spark, folder):
    h = history(spark, folder)
    return rs.at_best_round(h, rs.best_round(h))


@query("res_1_best_round", f"WITH {BEST} SELECT run, best_round, round(best_value, 6) AS best_value FROM best")
def best_round(spark, folder):
    return rs.best_round(history(spark, folder)).select("run", "best_round", rounded("best_value"))


@query("res_2_values_at_best_round", f"WITH {BEST} SELECT run, round, phase, center_id, metric, round(value, 6) AS value, n_rows FROM chosen")
def at_best_round(spark, folder):
    out = chosen(spark, folder)
    return out.select("run", "round", "phase", "center_id", "metric", rounded("value"), "n_rows")


@query(
    "res_3_center_summary",
    f"WITH {SUMMARY} SELECT phase, metric, center_id, round(mean, 6) AS mean, round(std, 6) AS std, n_runs FROM summ",
)
def center_summary(spark, folder):
    out = rs.center_summary(chosen(spark, folder))
    return out.select("phase", "metric", "center_id", rounded("mean"), rounded("std"), "n_runs")


@query(
    "res_4_weighted_summary",
    f"""WITH {SUMMARY}, {WEIGHTS}, j AS (SELECT s.*, n_rows, sum(n_rows * mean) OVER p / sum(n_rows) OVER p AS m FROM summ s JOIN wt USING (center_id)
          WINDOW p AS (PARTITION BY phase, metric))
        SELECT phase, metric, round(any_value(m), 6) AS mean, round(sqrt(sum(n_rows * (mean - m) * (mean - m)) / sum(n_rows)), 6) AS std FROM j GROUP BY ALL""",
)
def weighted_summary(spark, folder):
    rows = chosen(spark, folder)
    out = rs.weighted_summary(rs.center_summary(rows), rs.first_run_weights(rows))
    return out.select("phase", "metric", rounded("mean"), rounded("std"))


@query(
    "res_5_held_out",
    f"""WITH {BEST}, central AS (SELECT run, round, metric, avg(value) AS value FROM history WHERE phase = 'test' AND (run <> 0 OR round = 3) GROUP BY ALL),
        n AS (SELECT run, count(DISTINCT round) AS n, min(round) AS one FROM central GROUP BY 1)
        SELECT c.run, metric, round(value, 6) AS value FROM central c JOIN n ON n.run = c.run JOIN best b ON b.run = c.run
        WHERE c.round = CASE WHEN n = 1 THEN one ELSE best_round END""",
)
def held_out(spark, folder):
    h = history(spark, folder)
    central = h.where("phase = 'test' AND (run <> 0 OR round = 3)").groupBy("run", "round", "metric").agg(F.avg("value").alias("value"))
    return rs.held_out(central, rs.best_round(h)).select("run", "metric", rounded("value"))


NAMES = ["accuracy", "recall"]
PIVOT = ", ".join(
    f"round(max(mean) FILTER (metric = '{n}'), 6) AS {n}, round(max(std) FILTER (metric = '{n}'), 6) AS {n}_std" for n in NAMES
)


@query(
    "res_6_center_pivot",
    f"""WITH {SUMMARY}, {WEIGHTS} SELECT center_id, {PIVOT}, any_value(5 * n_rows - 1) AS train_n_samples
        FROM summ JOIN wt USING (center_id) WHERE phase = 'test' GROUP BY 1""",
)
def center_pivot(spark, folder):
    rows = chosen(spark, folder)
    wide = rs.center_pivot(rs.center_summary(rows), rs.train_sizes(rs.first_run_weights(rows)), NAMES)
    cols = [c for n in NAMES for c in (rounded(n), rounded(f"{n}_std"))]
    return wide.select("center_id", *cols, "train_n_samples")


@query(
    "res_7_display_names",
    f"""WITH {V.STATS} SELECT center_id, CASE center_id WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'West'
        ELSE 'center_' || cast(center_id + 1 AS varchar) END AS center, n_rows FROM stats""",
)
def display_names(spark, folder):
    sizes = V.center_stats(spark, folder).select("center_id", "n_rows")
    return rs.display_names(sizes, ["North", "South", "West"]).select("center_id", "center", "n_rows")


@query(
    "res_8_sections",
    f"""WITH {SUMMARY} SELECT CASE phase WHEN 'val' THEN 'Validation set' WHEN 'local' THEN 'Non federated'
        WHEN 'personalized' THEN 'Federated finetuned locally' ELSE 'Test set' END AS section, metric, count(*) AS n FROM summ GROUP BY ALL""",
)
def sections(spark, folder):
    out = rs.with_section(rs.center_summary(chosen(spark, folder)))
    return out.groupBy("section", "metric").agg(F.count(F.lit(1)).alias("n"))


@query(
    "res_9_execution_stats",
    f"""WITH {BEST}, r AS (SELECT metric, run, avg(value) AS m, sum(value) AS s, count(*) AS n FROM chosen WHERE metric IN ('accuracy', 'f1') GROUP BY ALL)
        SELECT metric, round(sum(s) / sum(n), 6) AS mean, round(stddev_pop(m), 6) AS std FROM r GROUP BY 1""",
)
def execution_stats(spark, folder):
    return rs.execution_stats(chosen(spark, folder), ["accuracy", "f1"]).select("metric", rounded("mean"), rounded("std"))


HEAD = ", ".join(f"round(max(mean) FILTER (metric = '{n}'), 6) AS {n}" for n in rs.HEADLINE)


@query(
    "res_10_model_comparison",
    f"""WITH {SUMMARY} SELECT center_id, CASE phase WHEN 'test' THEN 'federated' ELSE phase END AS model, {HEAD} FROM summ
        WHERE phase <> 'val' GROUP BY ALL""",
)
def model_comparison(spark, folder):
    out = rs.model_comparison(rs.center_summary(chosen(spark, folder)))
    return out.select("center_id", "model", *[rounded(n) for n in rs.HEADLINE])


@query(
    "res_11_size_and_quality",
    f"""WITH {SUMMARY}, {WEIGHTS}, w AS (SELECT center_id, any_value(5 * n_rows - 1) AS t, max(mean) FILTER (metric = 'accuracy') AS a
          FROM summ JOIN wt USING (center_id) WHERE phase = 'test' GROUP BY 1)
        SELECT center_id, t AS train_n_samples, round(a, 6) AS accuracy, round(t / sum(t) OVER (), 6) AS share FROM w""",
)
def size_and_quality(spark, folder):
    rows = chosen(spark, folder)
    wide = rs.center_pivot(rs.center_summary(rows), rs.train_sizes(rs.first_run_weights(rows)), NAMES)
    out = rs.size_and_quality(wide, "accuracy")
    return out.select("center_id", "train_n_samples", rounded("accuracy"), rounded("share"))


GRID = """g AS (SELECT dataset, model, a AS alpha, 'global' AS normalization, CASE WHEN dataset = 'signup' THEN 4 ELSE k END AS num_clients,
    CASE WHEN contains(model, 'forest') THEN 1 ELSE 60 END AS num_rounds
  FROM (VALUES ('signup'), ('purchase'), ('click')) d(dataset), (VALUES ('logistic_regression'), ('random_forest'), ('xgb')) m(model),
       (VALUES (0.7e0), (NULL)) a(a), (VALUES (1), (5), (10)) k(k))"""
SQL_NAME = """'grid_' || g.dataset || '_' || model || '_c' || cast(num_clients AS varchar) || '_a' || coalesce(cast(alpha AS varchar), 'None') || '_normglobal_featNone'"""


def grid(spark):
    return rs.condition_grid(
        spark, "grid", ["signup", "purchase", "click"], [1, 5, 10], [0.7, None], ["logistic_regression", "random_forest", "xgb"],
        fixed_clients={"signup": 4},
    )


@query(
    "res_12_condition_grid",
    f"""WITH {GRID}, s AS (SELECT event_type AS dataset, count(*) AS n_rows FROM events GROUP BY 1)
        SELECT DISTINCT {SQL_NAME} AS name, g.dataset, num_clients, num_rounds, n_rows // num_clients AS rows_per_center FROM g JOIN s ON s.dataset = g.dataset""",
)
def condition_grid(spark, folder):
    """Every condition with the rows its data set gives each center."""
    sizes = V.table(spark, folder, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n_rows"))
    out = grid(spark).join(sizes, "dataset")
    return out.select("name", "dataset", "num_clients", "num_rounds", F.floor(F.col("n_rows") / F.col("num_clients")).alias("rows_per_center"))


@query(
    "res_13_repetitions",
    f"""WITH {V.SCORED}, r AS (SELECT cast(i + 1 AS integer) AS run, cast(i + 10 AS integer) AS seed FROM range(5) t(i)),
        x AS (SELECT run, seed, row_key, center_id, label, row_number() OVER (PARTITION BY run, center_id, label
              ORDER BY {V.sql_hash('row_key', ('seed',))}, row_key) AS pos, count(*) OVER (PARTITION BY run, center_id, label) AS n FROM scored, r)
        SELECT run, seed, center_id, count(*) FILTER (pos <= least(round(n * 0.2e0), n - 1)) AS n_test,
               round(avg(CASE WHEN pos <= least(round(n * 0.2e0), n - 1) THEN cast(row_key AS double) END), 4) AS mean_key FROM x GROUP BY ALL""",
)
def repetitions(spark, folder):
    """Five runs with their own seeds, each seeding its own stratified split."""
    from centrum.operators.splits import stratified_split

    rows = V.scored_rows(spark, folder).select("row_key", "center_id", "label")
    runs = rs.repetitions(rows)
    split = stratified_split(runs, "row_key", 0.2, (F.col("seed"),), extra=["run", "seed"])
    held = F.col("split") == "test"
    return split.groupBy("run", "seed", "center_id").agg(
        F.count_if(held).alias("n_test"), F.round(F.avg(F.when(held, F.col("row_key").cast("double"))), 4).alias("mean_key")
    )


@query(
    "res_14_run_summary",
    f"""WITH {BEST} SELECT run, round, phase, metric, round(avg(value), 6) AS value,
        array_to_string(list(cast(round(value * 1000) AS bigint) ORDER BY center_id), ',') AS per_center FROM chosen GROUP BY ALL""",
)
def run_summary(spark, folder):
    out = rs.run_summary(history(spark, folder))
    text = F.array_join(F.transform("per_center", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    return out.select("run", "round", "phase", "metric", rounded("value"), text.alias("per_center"))
