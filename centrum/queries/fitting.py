"""Preprocessing fit, feature selection, merge over centers and apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from centrum.operators import prep, selection as fs
from centrum.operators.ordering import settle
from centrum.plans import views as V
from centrum.queries.registry import query, rounded

NUM, TXT = ["o_totalprice", "c_acctbal"], ["o_orderpriority", "c_mktsegment"]

LONG_NUM = f"""{V.CLINIC}, numlong AS (
  SELECT row_key, center_id, label, 'o_totalprice' AS "column", o_totalprice AS v FROM clinic UNION ALL
  SELECT row_key, center_id, label, 'c_acctbal', c_acctbal FROM clinic)"""
LONG_TXT = f"""{V.CLINIC}, txtlong AS (
  SELECT row_key, center_id, 'o_orderpriority' AS "column", o_orderpriority AS v FROM clinic UNION ALL
  SELECT row_key, center_id, 'c_mktsegment', c_mktsegment FROM clinic)"""
CODES = """codes AS (SELECT center_id, "column", v, dense_rank() OVER (PARTITION BY center_id, "column" ORDER BY v) - 1 AS code
  FROM (SELECT DISTINCT center_id, "column", v FROM txtlong WHERE v IS NOT NULL
        UNION SELECT DISTINCT center_id, "column", 'unknown' FROM txtlong WHERE v IS NOT NULL))"""
MODES = """modes AS (SELECT center_id, "column", v AS mode FROM (
    SELECT center_id, "column", v, row_number() OVER (PARTITION BY center_id, "column" ORDER BY count(*) DESC, v) AS rn
    FROM txtlong WHERE v IS NOT NULL GROUP BY center_id, "column", v) WHERE rn = 1),
  txtfill AS (SELECT m.* FROM modes m JOIN (SELECT center_id, "column" FROM txtlong GROUP BY ALL HAVING count(*) > count(v)) USING (center_id, "column"))"""
NUMFILL = """numfill AS (SELECT center_id, "column", coalesce(median(v), 0) AS fill FROM numlong GROUP BY ALL HAVING count(*) > count(v))"""
NUMSTAT = """numstat AS (SELECT center_id, "column", avg(x) AS mean, coalesce(nullif(stddev_samp(x), 0), 1) AS std
  FROM (SELECT n.center_id, n."column", coalesce(v, fill) AS x FROM numlong n LEFT JOIN numfill f ON f.center_id = n.center_id AND f."column" = n."column") GROUP BY ALL)"""
TXTSTAT = """txtstat AS (SELECT center_id, "column", avg(x) AS mean, coalesce(nullif(stddev_samp(x), 0), 1) AS std
  FROM (SELECT t.center_id, t."column", cast(coalesce(c.code, -1) AS double) AS x FROM txtlong t
        LEFT JOIN txtfill f ON f.center_id = t.center_id AND f."column" = t."column"
        LEFT JOIN codes c ON c.center_id = t.center_id AND c."column" = t."column" AND c.v = coalesce(t.v, f.mode)) GROUP BY ALL)"""
FITTED = f"""{LONG_NUM}, {LONG_TXT[len(V.CLINIC) + 2:]}, {CODES}, {MODES}, {NUMFILL}, {NUMSTAT}, {TXTSTAT},
  stat AS (SELECT * FROM numstat UNION ALL SELECT * FROM txtstat),
  size AS (SELECT center_id, count(*) AS n_rows FROM clinic GROUP BY 1),
  wts AS (SELECT center_id, n_rows / cast(sum(n_rows) OVER () AS double) AS w, 1e0 / count(*) OVER () AS we FROM size)"""


def sql_pooled(w: str) -> str:
    return f"""gm AS (SELECT "column", sum({w} * mean) / sum({w}) AS m FROM stat JOIN wts USING (center_id) GROUP BY 1),
  pooled AS (SELECT s."column", any_value(m) AS mean, CASE WHEN sum({w}*std*std) + sum({w}*(s.mean-m)*(s.mean-m)) > 0
     THEN sqrt(sum({w}*std*std) + sum({w}*(s.mean-m)*(s.mean-m))) ELSE 1 END AS std
     FROM stat s JOIN wts USING (center_id) JOIN gm ON gm."column" = s."column" GROUP BY 1),
  mnum AS (SELECT "column", sum({w} * fill) / sum({w}) AS num_value FROM numfill JOIN wts USING (center_id) GROUP BY 1),
  mtxt AS (SELECT "column", mode AS str_value FROM (SELECT "column", mode, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, min(center_id)) AS rn
     FROM txtfill GROUP BY "column", mode) WHERE rn = 1),
  big AS (SELECT center_id FROM size ORDER BY n_rows DESC, center_id LIMIT 1),
  mcodes AS (SELECT "column", v, code FROM codes JOIN big USING (center_id))"""


def clinic(spark, folder):
    return V.clinic_rows(spark, folder)


def fitted(spark, folder):
    return prep.fit(clinic(spark, folder), NUM, TXT)


@query(
    "fit_1_nulls",
    f"""WITH {LONG_NUM}, {LONG_TXT[len(V.CLINIC) + 2:]}
        SELECT center_id, "column", count(*) - count(v) AS n_null FROM
        (SELECT center_id, "column", cast(v AS varchar) AS v FROM numlong UNION ALL SELECT center_id, "column", v FROM txtlong) GROUP BY ALL""",
)
def nulls(spark, folder):
    return prep.null_counts(clinic(spark, folder), NUM + TXT)


@query(
    "fit_2_median",
    f'WITH {LONG_NUM}, {NUMFILL} SELECT center_id, "column", round(fill, 6) AS num_value FROM numfill',
)
def medians(spark, folder):
    return prep.numeric_imputation(clinic(spark, folder), NUM).select("center_id", "column", rounded("num_value"))


@query("fit_3_mode", f'WITH {LONG_TXT}, {MODES} SELECT center_id, "column", mode AS str_value FROM txtfill')
def modes(spark, folder):
    return prep.categorical_imputation(prep.value_counts(clinic(spark, folder), TXT))


@query("fit_4_label_codes", f'WITH {LONG_TXT}, {CODES} SELECT center_id, "column", v AS value, code FROM codes')
def codes(spark, folder):
    return prep.label_codes(settle(prep.value_counts(clinic(spark, folder), TXT)))


@query(
    "fit_5_codes_for_moments",
    f"""WITH {LONG_TXT}, c AS (SELECT *, CASE WHEN v IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY center_id, "column", v IS NULL ORDER BY v) - 1 END AS code FROM txtlong)
        SELECT center_id, "column", count(*) AS n_rows, round(avg(code), 6) AS mean, round(stddev_samp(code), 6) AS std FROM c GROUP BY ALL""",
)
def plain_codes(spark, folder):
    counts = settle(prep.value_counts(clinic(spark, folder), TXT))
    out = prep.code_moments(counts, prep.label_codes(counts, with_unknown=False))
    return out.select("center_id", "column", "n_rows", rounded("mean"), rounded("std"))


@query("fit_6_mean", f'WITH {LONG_NUM} SELECT center_id, "column", round(avg(v), 6) AS mean FROM numlong GROUP BY ALL')
def means(spark, folder):
    return prep.numeric_moments(clinic(spark, folder), NUM).select("center_id", "column", rounded("mean"))


@query(
    "fit_7_std",
    f"""WITH {LONG_NUM}, x AS (SELECT * FROM numlong UNION ALL SELECT row_key, center_id, label, 'one', 1 FROM clinic)
        SELECT center_id, "column", round(coalesce(nullif(stddev_samp(v), 0), 1), 6) AS std FROM x GROUP BY ALL""",
)
def stds(spark, folder):
    m = prep.numeric_moments(clinic(spark, folder).withColumn("one", F.lit(1.0)), NUM + ["one"])
    return m.select("center_id", "column", rounded("std", of=prep.usable_std(F.col("std"))))


@query(
    "fit_8_imputed_moments",
    f"""WITH {FITTED} SELECT center_id, "column", round(mean, 6) AS mean, round(std, 6) AS std FROM stat""",
)
def imputed(spark, folder):
    return fitted(spark, folder).moments.select("center_id", "column", rounded("mean"), rounded("std"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_F = f"""{V.PLANTED}, flong AS (SELECT row_key, center_id, label, feature, v FROM (
  SELECT row_key, center_id, label, l_quantity, l_extendedprice, l_discount, l_tax FROM planted)
  UNPIVOT (v FOR feature IN ({', '.join(FEATURES)})))"""
MI = """edge AS (SELECT center_id, feature, min(v) AS lo, max(v) AS hi FROM flong GROUP BY ALL),
  cell AS (SELECT f.center_id, f.feature, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 16), 15) ELSE 0 END AS bin, label, count(*) AS n
           FROM flong f JOIN edge e ON e.center_id = f.center_id AND e.feature = f.feature GROUP BY ALL),
  tot AS (SELECT *, sum(n) OVER (PARTITION BY center_id, feature) AS t, sum(n) OVER (PARTITION BY center_id, feature, bin) AS b,
                 sum(n) OVER (PARTITION BY center_id, feature, label) AS l FROM cell),
  mi AS (SELECT center_id, feature, sum(n / cast(t AS double) * ln(n * cast(t AS double) / (cast(b AS double) * l))) AS score FROM tot GROUP BY ALL)"""
ANOVA = """cls AS (SELECT center_id, feature, label, count(v) AS n, avg(v) AS m, var_pop(v) AS s FROM flong GROUP BY ALL),
  grand AS (SELECT center_id, feature, sum(n * m) / sum(n) AS g, sum(n) AS nn, count(*) AS k, sum(n * s) AS wit FROM cls GROUP BY ALL),
  anova AS (SELECT c.center_id, c.feature, (sum(c.n * (c.m - g) * (c.m - g)) / (any_value(k) - 1)) / (any_value(wit) / (any_value(nn) - any_value(k))) AS score
            FROM cls c JOIN grand d ON d.center_id = c.center_id AND d.feature = c.feature GROUP BY ALL)"""


@query("fs_1_mutual_info", f"WITH {LONG_F}, {MI} SELECT center_id, feature, round(score, 6) AS score FROM mi")
def mutual_info(spark, folder):
    return fs.binned_mutual_info(V.planted_rows(spark, folder), FEATURES).select("center_id", "feature", rounded("score"))


@query("fs_2_anova", f"WITH {LONG_F}, {ANOVA} SELECT center_id, feature, round(score, 4) AS score FROM anova")
def anova(spark, folder):
    return fs.anova_f(V.planted_rows(spark, folder), FEATURES).select("center_id", "feature", rounded("score", 4))


@query("fs_3_forest_importance")
def importance(spark, folder):
    rows = V.clinic_rows(spark, folder).na.fill(0.0)
    return fs.forest_importance(rows, NUM).select("center_id", "feature", rounded("score"))


@query(
    "fs_4_rank_and_cut",
    f"""WITH {LONG_F}, {ANOVA}, r AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, feature) AS place FROM anova)
        SELECT center_id, feature, place, round(score, 4) AS score FROM r WHERE place <= 2""",
)
def ranked(spark, folder):
    out = fs.select_features(V.planted_rows(spark, folder), FEATURES, 2, "f_classif")
    return out.select("center_id", "feature", "place", rounded("score", 4))


@query(
    "fs_5_fill",
    f"""WITH {LONG_NUM}, md AS (SELECT center_id, "column", median(v) AS m FROM numlong GROUP BY ALL)
        SELECT c.row_key, coalesce(o_totalprice, a.m, 0) AS o_totalprice, coalesce(c_acctbal, b.m, 0) AS c_acctbal FROM clinic c
        LEFT JOIN md a ON a.center_id = c.center_id AND a."column" = 'o_totalprice'
        LEFT JOIN md b ON b.center_id = c.center_id AND b."column" = 'c_acctbal'""",
)
def filled(spark, folder):
    rows = clinic(spark, folder).select("row_key", "center_id", *NUM)
    return fs.fill_for_scores(rows, NUM).drop("center_id")


@query(
    "fs_6_vote",
    f"""WITH {LONG_F}, {ANOVA}, r AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, feature) AS place FROM anova),
        z AS (SELECT center_id, count(*) AS n FROM planted GROUP BY 1), w AS (SELECT center_id, n / cast(sum(n) OVER () AS double) AS w FROM z)
        SELECT feature, round(sum(w), 6) AS votes FROM r JOIN w USING (center_id) WHERE place <= 2 GROUP BY 1
        ORDER BY round(sum(w), 9) DESC, feature LIMIT 2""",
)
def vote(spark, folder):
    p = V.planted_rows(spark, folder)
    weights = prep.center_weights(p.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows")))
    chosen = fs.rank_features(fs.anova_f(p, FEATURES), 2)
    return fs.vote_features(chosen, weights, 2).select("feature", rounded("votes"))


@query(
    "agg_1_center_weights",
    f"WITH {V.STATS} SELECT center_id, round(n_rows / sum(n_rows) OVER (), 6) AS weight, round(1e0 / count(*) OVER (), 6) AS equal_weight FROM stats",
)
def weights(spark, folder):
    sizes = V.center_stats(spark, folder)
    equal = prep.center_weights(sizes, equal=True).withColumnRenamed("weight", "equal_weight")
    return prep.center_weights(sizes).join(equal, "center_id").select("center_id", rounded("weight"), rounded("equal_weight"))


@query(
    "agg_2_columns",
    f"""WITH {FITTED} SELECT "column" FROM numfill UNION SELECT "column" FROM txtfill UNION SELECT "column" FROM stat UNION SELECT "column" FROM codes""",
)
def universe(spark, folder):
    p = fitted(spark, folder)
    return prep.column_universe(p.imputation, p.moments, p.codes)


@query(
    "agg_3_numeric_imputation",
    f"""WITH {FITTED}, {sql_pooled('w')} SELECT "column", round(num_value, 6) AS num_value FROM mnum""",
)
def merged_fill(spark, folder):
    p = fitted(spark, folder)
    return prep.merge_numeric_imputation(p.imputation, prep.center_weights(p.sizes)).select("column", rounded("num_value"))


@query("agg_4_text_imputation", f"""WITH {FITTED}, {sql_pooled('w')} SELECT "column", str_value FROM mtxt""")
def merged_text(spark, folder):
    return prep.merge_text_imputation(fitted(spark, folder).imputation)


def pooled(spark, folder, equal: bool):
    p = fitted(spark, folder)
    return prep.merge_moments(p.moments, prep.center_weights(p.sizes, equal))


@query("agg_5_pooled_mean", f"""WITH {FITTED}, {sql_pooled('w')} SELECT "column", round(mean, 6) AS mean FROM pooled""")
def pooled_mean(spark, folder):
    return pooled(spark, folder, False).select("column", rounded("mean"))


@query("agg_6_pooled_std", f"""WITH {FITTED}, {sql_pooled('we')} SELECT "column", round(mean, 6) AS mean, round(std, 6) AS std FROM pooled""")
def pooled_std(spark, folder):
    return pooled(spark, folder, True).select("column", rounded("mean"), rounded("std"))


@query("agg_7_encoder", f"""WITH {FITTED}, {sql_pooled('w')} SELECT "column", v AS value, code FROM mcodes""")
def encoder(spark, folder):
    p = fitted(spark, folder)
    return prep.largest_center_codes(p.codes, p.sizes)


@query(
    "agg_8_methods",
    f"""WITH {FITTED}, {sql_pooled('w')}, {sql_pooled('we').replace('gm AS', 'gm2 AS').replace('JOIN gm ON gm.', 'JOIN gm2 ON gm2.').replace('pooled AS', 'pooled2 AS').split('mnum AS')[0].rstrip().rstrip(',')}
        SELECT 'weighted_aggregate' AS method, "column", round(mean, 6) AS mean, round(std, 6) AS std FROM pooled UNION ALL
        SELECT 'equal_aggregate', "column", round(mean, 6), round(std, 6) FROM pooled2 UNION ALL
        SELECT 'reference', "column", round(mean, 6), round(std, 6) FROM stat JOIN big USING (center_id)""",
)
def methods(spark, folder):
    p = fitted(spark, folder)
    parts = [
        prep.merge(p, m).columns.select(F.lit(m).alias("method"), "column", rounded("mean"), rounded("std"))
        for m in ("weighted_aggregate", "equal_aggregate", "reference")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merged(spark, folder):
    return prep.merge(fitted(spark, folder), "weighted_aggregate")


FILLED = f"""{FITTED}, {sql_pooled('w')}, filled AS (SELECT row_key, center_id, label,
  coalesce(o_totalprice, (SELECT num_value FROM mnum WHERE "column" = 'o_totalprice')) AS o_totalprice, c_acctbal,
  coalesce(o_orderpriority, (SELECT str_value FROM mtxt WHERE "column" = 'o_orderpriority')) AS o_orderpriority, c_mktsegment FROM clinic)"""
CODED = f"""{FILLED}, coded AS (SELECT row_key, f.center_id, label, o_totalprice, c_acctbal,
  cast(CASE WHEN o_orderpriority IS NULL THEN -1 ELSE coalesce(a.code, ua.code) END AS double) AS o_orderpriority,
  cast(CASE WHEN c_mktsegment IS NULL THEN -1 ELSE coalesce(b.code, ub.code) END AS double) AS c_mktsegment
  FROM filled f LEFT JOIN mcodes a ON a."column" = 'o_orderpriority' AND a.v = o_orderpriority
  LEFT JOIN mcodes b ON b."column" = 'c_mktsegment' AND b.v = c_mktsegment
  LEFT JOIN mcodes ua ON ua."column" = 'o_orderpriority' AND ua.v = 'unknown'
  LEFT JOIN mcodes ub ON ub."column" = 'c_mktsegment' AND ub.v = 'unknown')"""
SCALED = ", ".join(
    f"""round(({c} - (SELECT mean FROM pooled WHERE "column" = '{c}')) / (SELECT std FROM pooled WHERE "column" = '{c}'), 6) AS {c}""" for c in NUM + TXT
)


@query(
    "app_1_fill_nulls",
    f"WITH {FILLED} SELECT row_key, round(o_totalprice, 6) AS o_totalprice, c_acctbal, o_orderpriority, c_mktsegment FROM filled",
)
def fill(spark, folder):
    out = prep.fill_nulls(clinic(spark, folder), merged(spark, folder).columns)
    return out.select("row_key", rounded("o_totalprice"), "c_acctbal", *TXT)


# The encoder is fitted on the clinic rows without two priorities, so both are unseen when it is applied.
UNSEEN = f"""{V.CLINIC}, base AS (SELECT * FROM clinic WHERE o_orderpriority NOT IN ('3-MEDIUM', '5-LOW')),
  big AS (SELECT center_id FROM base GROUP BY 1 ORDER BY count(*) DESC, center_id LIMIT 1),
  vals AS (SELECT DISTINCT o_orderpriority AS v FROM base JOIN big USING (center_id) UNION SELECT 'unknown'),
  enc AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM vals)"""


@query(
    "app_2_encode",
    f"""WITH {UNSEEN} SELECT row_key, cast(CASE WHEN o_orderpriority IS NULL THEN -1
        ELSE coalesce(code, (SELECT code FROM enc WHERE v = 'unknown')) END AS double) AS o_orderpriority
        FROM clinic LEFT JOIN enc ON v = o_orderpriority""",
)
def encode(spark, folder):
    rows = clinic(spark, folder)
    base = rows.where(~F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW"))
    counts = settle(prep.value_counts(base, ["o_orderpriority"]))
    sizes = base.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows"))
    table = prep.largest_center_codes(prep.label_codes(counts), sizes)
    return prep.encode(rows, ["o_orderpriority"], table).select("row_key", "o_orderpriority")


@query(
    "app_3_local_codes",
    f"""WITH {V.CLINIC} SELECT row_key, cast(CASE WHEN o_orderpriority IS NULL THEN -1
        ELSE dense_rank() OVER (PARTITION BY o_orderpriority IS NULL ORDER BY o_orderpriority) - 1 END AS double) AS o_orderpriority FROM clinic""",
)
def local_codes(spark, folder):
    return prep.encode_locally(clinic(spark, folder), "o_orderpriority").select("row_key", "o_orderpriority")


@query("app_4_scale_globally", f"WITH {CODED} SELECT row_key, {SCALED} FROM coded")
def scale_globally(spark, folder):
    out = prep.apply(clinic(spark, folder), NUM, TXT, merged(spark, folder), "global")
    return out.select("row_key", *[rounded(c) for c in NUM + TXT])


def sql_local(c: str) -> str:
    return f"round(({c} - avg({c}) OVER p) / coalesce(nullif(stddev_samp({c}) OVER p, 0), 1), 6) AS {c}"


@query(
    "app_5_scale_locally",
    f"""WITH {V.PLANTED}, s AS (SELECT *, CASE WHEN {V.sql_hash('row_key', 42)} % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM planted)
        SELECT row_key, center_id, split, {sql_local('l_quantity')}, {sql_local('l_extendedprice')}, {sql_local('l_discount')} FROM s
        WINDOW p AS (PARTITION BY center_id, split)""",
)
def scale_locally(spark, folder):
    from centrum.functions.columns import row_hash

    names = ["l_quantity", "l_extendedprice", "l_discount"]
    split = F.when(row_hash("row_key", 42) % 5 == 0, "test").otherwise("train")
    rows = V.planted_rows(spark, folder).select("row_key", "center_id", split.alias("split"), *names)
    out = prep.scale_locally(rows, names, ["center_id", "split"])
    return out.select("row_key", "center_id", "split", *[rounded(c) for c in names])


@query(
    "app_6_no_scaling",
    f"WITH {CODED} SELECT row_key, round(o_totalprice, 6) AS o_totalprice, c_acctbal, o_orderpriority, c_mktsegment FROM coded",
)
def no_scaling(spark, folder):
    out = prep.apply(clinic(spark, folder), NUM, TXT, merged(spark, folder), None)
    return out.select("row_key", rounded("o_totalprice"), "c_acctbal", *TXT)


@query("app_7_selected_features", f"WITH {CODED} SELECT row_key, center_id, label, {SCALED.split(', round')[0]} FROM coded")
def selected(spark, folder):
    params = merged(spark, folder)
    params.selected = ["o_totalprice"]
    out = prep.apply(clinic(spark, folder), NUM, TXT, params, "global")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "app_8_same_params_for_splits",
    f"""WITH {CODED}, s AS (SELECT *, CASE WHEN {V.sql_hash('row_key', 3)} % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM coded)
        SELECT split, center_id, count(*) AS n, round(avg((o_totalprice - (SELECT mean FROM pooled WHERE "column" = 'o_totalprice'))
          / (SELECT std FROM pooled WHERE "column" = 'o_totalprice')), 6) AS o_totalprice FROM s GROUP BY ALL""",
)
def both_splits(spark, folder):
    from centrum.functions.columns import row_hash

    rows = clinic(spark, folder).withColumn("split", F.when(row_hash("row_key", 3) % 5 == 0, "test").otherwise("train"))
    out = prep.apply(rows, NUM, TXT, merged(spark, folder), "global")
    return out.groupBy("split", "center_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("o_totalprice"))
