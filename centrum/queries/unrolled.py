"""SQL of whole training loops: every round of linear training written out as tables of its own."""

from __future__ import annotations

import numpy as np

from centrum.operators.centers import draw_shares
from centrum.plans import views as V
from centrum.queries import models
from centrum.queries.assign import H42, sql_slices
from centrum.queries.registry import ORACLES
from centrum.queries.scoring import TUNED_KEYS, sql_all, sql_best, sql_long

WEIGHTS = [f"w{i}" for i in range(V.WIDTH)]
MARGIN = " + ".join(["b", *[f"w{i} * f{i}" for i in range(V.WIDTH)]])

SPLIT = f"""{V.PLANTED}, sp AS MATERIALIZED (SELECT center_id, label, f0, f1, f2, f3,
      CASE WHEN i < t THEN 'test' WHEN i < t + round((n - t) * 0.2e0) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, round(n * 0.2e0) AS t FROM (SELECT *, row_number() OVER (PARTITION BY center_id, label ORDER BY {H42}, row_key) - 1 AS i,
      count(*) OVER (PARTITION BY center_id, label) AS n FROM planted)))"""


def sql_rounds(source: str, num_rounds: int, rate: float, percent: float | None = None) -> str:
    """Tables c1, m1, c2, m2, ...: the centers' models and the merged model of each round of logistic regression. With a
    ``percent`` that share of the centers, drawn by hash, takes no part in a round after the first."""
    each = lambda rule: ", ".join(rule(i) for i in range(V.WIDTH))
    parts = [
        f"""tr AS MATERIALIZED (SELECT s.*, weight FROM {source} s JOIN (SELECT center_id, label, sum(count(*)) OVER (PARTITION BY center_id) / (2e0 * count(*)) AS weight
            FROM {source} GROUP BY center_id, label) USING (center_id, label))""",
        "st AS (SELECT center_id, count(*) OVER () AS k FROM (SELECT DISTINCT center_id FROM tr))",
        f"m0 AS (SELECT {each(lambda i: f'0e0 AS w{i}')}, 0e0 AS b)",
    ]
    for r in range(1, num_rounds + 1):
        there = "SELECT center_id FROM st"
        if percent is not None and r > 1:
            there = f"""SELECT center_id FROM (SELECT center_id, k, row_number() OVER (ORDER BY {V.sql_hash('center_id', 42, r)}, center_id) AS place FROM st)
                WHERE place <= k - ceil({percent}e0 / 100 * k)"""
        parts += [
            f"""g{r} AS MATERIALIZED (SELECT center_id, count(*) AS n, {each(lambda i: f'sum(weight * s * f{i}) AS g{i}')}, sum(weight * s) AS gb
                FROM (SELECT tr.*, 1e0 / (1e0 + exp(-({MARGIN}))) - label AS s FROM tr, m{r - 1} WHERE center_id IN ({there})) GROUP BY 1)""",
            f"""c{r} AS MATERIALIZED (SELECT center_id, n, {each(lambda i: f'w{i} - {rate}e0 * (g{i} + w{i}) / n AS w{i}')}, b - {rate}e0 * gb / n AS b FROM g{r}, m{r - 1})""",
            f"m{r} AS MATERIALIZED (SELECT {each(lambda i: f'sum(n * w{i}) / sum(n) AS w{i}')}, sum(n * b) / sum(n) AS b FROM c{r})",
        ]
    return ",\n".join(parts)


def sql_alone(source: str, steps: int, rate: float) -> str:
    """Table c{steps}: the centers' models after so many passes without a merge."""
    whole = sql_rounds(source, 1, rate)
    parts = [whole]
    for r in range(2, steps + 1):
        sums = ", ".join(f"sum(weight * s * f{i}) AS g{i}" for i in range(V.WIDTH))
        moved = ", ".join(f"w{i} - {rate}e0 * (g{i} + w{i}) / g{r}.n AS w{i}" for i in range(V.WIDTH))
        parts += [
            f"""g{r} AS MATERIALIZED (SELECT center_id, count(*) AS n, {sums}, sum(weight * s) AS gb
                FROM (SELECT tr.*, 1e0 / (1e0 + exp(-({MARGIN}))) - label AS s FROM tr JOIN c{r - 1} USING (center_id)) GROUP BY 1)""",
            f"c{r} AS MATERIALIZED (SELECT center_id, g{r}.n, {moved}, b - {rate}e0 * gb / g{r}.n AS b FROM g{r} JOIN c{r - 1} USING (center_id))",
        ]
    return ",\n".join(parts)


def sql_history(model: str, round_no: int, chosen: str, name: str = "phase", own: bool = True) -> str:
    """History rows of a model (one for each center, or one for all): thresholds from validation rows, metrics of all phases."""
    beside = f"JOIN {model} USING (center_id)" if own else f", {model}"
    return f"""sc AS MATERIALIZED (SELECT sp.center_id, label, split, 1e0 / (1e0 + exp(-({MARGIN}))) AS score FROM sp {beside} WHERE split <> 'train'),
        v AS (SELECT * FROM sc WHERE split = 'val'), {sql_best('v')},
        ph AS (SELECT s.center_id, split AS phase, score, label, coalesce(threshold, 0.5e0) AS cut FROM sc s LEFT JOIN best USING (center_id)
               UNION ALL SELECT center_id, 'not tuned', score, label, 0.5e0 FROM sc WHERE split = 'test'),
        {sql_all('ph', TUNED_KEYS, 'cut')}
        SELECT 1 AS run, {round_no} AS round, {name} AS phase, center_id, metric, round(value, 4) AS value, n_rows FROM ({sql_long('w', TUNED_KEYS).replace(', 6)', ', 12)')}) WHERE {chosen}"""


TRAIN = "(SELECT * FROM sp WHERE split = 'train')"

ORACLES["snk_3_model_checkpoint"] = (
    f"WITH {V.PLANTED}, {sql_rounds('planted', models.CHECKPOINTS, 1.0)} "
    + " UNION ALL ".join(f"SELECT {r} AS round, {V.WIDTH} AS width, round(b, 6) AS intercept FROM m{r}" for r in range(1, models.CHECKPOINTS + 1))
)
ORACLES["met_12_personalized"] = (
    f"WITH {SPLIT}, {sql_rounds(TRAIN, models.OWN_ROUNDS, 3.0)}, " + sql_history(f"c{models.OWN_ROUNDS}", models.OWN_ROUNDS, "phase = 'test'", "'personalized'")
)
ORACLES["trn_12_local_baseline"] = (
    f"WITH {SPLIT}, {sql_alone(TRAIN, models.LOCAL_PASSES, 3.0)}, " + sql_history(f"c{models.LOCAL_PASSES}", 0, "phase = 'test'", "'local'")
)
ORACLES["fed_19_linear_rounds"] = f"WITH {SPLIT}, {sql_rounds(TRAIN, 5, 3.0, 30.0)}, " + sql_history(
    "m5", 5, "metric IN ('auroc', 'balanced_accuracy')", own=False
)

ORACLES["scr_6_pooled_test"] = f"""WITH {V.PLANTED}, sp AS MATERIALIZED (SELECT center_id, label, f0, f1, f2, f3,
      CASE WHEN i < least(round(n * 0.2e0), n - 1) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY center_id, label ORDER BY {H42}, row_key) - 1 AS i, count(*) OVER (PARTITION BY center_id, label) AS n FROM planted)),
    {sql_rounds(TRAIN, models.OWN_ROUNDS, 3.0)},
    sc AS MATERIALIZED (SELECT label, split, 1e0 / (1e0 + exp(-({MARGIN}))) AS score FROM sp, m{models.OWN_ROUNDS} WHERE split = 'test'),
    {sql_all('sc', ['split'], '0.5e0')} SELECT split, metric, round(value, 4) AS value, n_rows FROM ({sql_long('w', ['split']).replace(', 6)', ', 12)')})"""


def drawn(classes: list[float], centers: int, alpha: float) -> list[tuple[float, int, float]]:
    """The shares that the Dirichlet draw gives, as fixed values for SQL."""
    return [(c, i, float(s)) for c in classes for i, s in enumerate(np.asarray(draw_shares(c, centers, alpha)))]


ORACLES["part_3_count_repair"] = f"""WITH {V.PLANTED}, base AS (SELECT * FROM planted), {sql_slices('label', drawn([0.0, 1.0], 10, 0.1), 10, floor=25)}
    SELECT cls AS label, cast(center_id AS integer) AS center_id, hi - lo AS n_rows, lo, hi FROM sl"""
