"""Sources, sinks and plain projections."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from centrum.functions import columns as C
from centrum.operators import targets
from centrum.plans import views as V
from centrum.queries.registry import query, rounded
from centrum.session import scratch_path
from centrum.sources import readers, sinks

CSV_SCHEMA = "row_key string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, label double"


@query(
    "src_1_csv_scan",
    f"""WITH {V.PLANTED} SELECT l_quantity, l_tax, label, count(*) AS n, round(sum(l_extendedprice), 2) AS price
        FROM planted GROUP BY ALL""",
)
def csv_scan(spark, folder):
    path = scratch_path(spark, "planted-csv")
    cols = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
    V.planted_rows(spark, folder).select(*cols).write.option("header", True).csv(path)
    data = readers.read_csv(spark, path, "label", "l_quantity, l_tax, l_extendedprice", schema=CSV_SCHEMA)
    return data.groupBy("l_quantity", "l_tax", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    "src_3_table_without_ids",
    "SELECT o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus AS label FROM orders",
)
def table_without_ids(spark, folder):
    return readers.without_ids(V.table(spark, folder, "orders"), "o_orderkey", "o_orderstatus")


@query(
    "src_4_natural_centers",
    """SELECT cast(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS integer) AS center_id, c_acctbal, c_name,
              c_mktsegment AS label FROM customer""",
)
def natural_centers(spark, folder):
    return readers.natural_center_table(V.table(spark, folder, "customer"), "c_nationkey", "c_custkey", "c_mktsegment")


SITE_NAMES = [f"src{(7 * i + 3) % 20}" for i in range(20)]  # all sources, in an order of the user's choice


@query(
    "src_5_named_centers",
    f"""WITH {V.SITE}, names AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(SITE_NAMES))}) t(source, i))
        SELECT row_key, cast(i AS integer) AS center_id, n_chars, lang, label FROM site JOIN names USING (source)""",
)
def named_site_centers(spark, folder):
    site = V.site_rows(spark, folder).drop("toxic", "score").withColumnRenamed("label", "quality")
    return readers.named_center_table(site, "source", SITE_NAMES, "quality")


@query(
    "src_6_libsvm",
    f"""WITH {V.PLANTED} SELECT label, round(l_quantity, 6) AS x1, round(l_discount, 6) AS x3, count(*) AS n,
        round(sum(l_tax), 4) AS x4 FROM planted GROUP BY 1, 2, 3""",
)
def libsvm(spark, folder):
    path = scratch_path(spark, "planted-libsvm")
    p = V.planted_rows(spark, folder)
    sign = F.when(F.col("label") == 1, "+1").otherwise("-1")
    parts = [F.concat(F.lit(f"{i + 1}:"), F.col(c).cast("string")) for i, c in enumerate(V.NUMERIC)]
    p.select(F.concat_ws(" ", sign, *parts)).write.text(path)
    x = F.col("features")
    data = readers.read_libsvm(spark, path, 4)
    return data.groupBy("label", F.round(x[0], 6).alias("x1"), F.round(x[2], 6).alias("x3")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(x[3]), 4).alias("x4")
    )


@query(
    "src_7_array_source",
    """WITH a AS (SELECT vec_id, cast(embedding AS double[]) AS e, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
       b AS (SELECT *, CASE WHEN pos <= 300 THEN 'train' ELSE 'test' END AS split FROM a)
       SELECT vec_id, split, len(e) - 1 AS width, round(list_sum(e[1:len(e)-1]), 4) AS total, round(e[len(e)], 6) AS label
       FROM b""",
)
def array_source(spark, folder):
    data = readers.array_source(V.array_rows(spark, folder), "features", "vec_id", cut=300)
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return data.select(
        "vec_id", "split", F.size("features").cast("bigint").alias("width"), F.round(total, 4).alias("total"), rounded("label")
    )


@query(
    "src_8_features_with_target",
    f"""SELECT d.doc_id, d.lang, d.n_chars, l.quality AS label FROM documents d JOIN labels l USING (doc_id)
        WHERE {V.sql_hash('doc_id', 42)} < {int(0.4 * C.HASH_RANGE)}""",
)
def features_with_target(spark, folder):
    docs = V.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    target = V.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return readers.features_with_target(docs, target, "doc_id", fraction=0.4)


@query(
    "snk_1_center_csv",
    f"""WITH {V.SCORED}, c AS (SELECT center_id, {V.sql_confusion('0.1e0')} FROM scored GROUP BY 1)
        SELECT center_id, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall FROM (SELECT center_id, {V.sql_rates()} FROM c)""",
)
def center_csv(spark, folder):
    from centrum.operators.metrics import confusion, with_rates

    path = scratch_path(spark, "center-results")
    wide = with_rates(confusion(V.scored_rows(spark, folder), ["center_id"], 0.1))
    sinks.write_center_results(wide.select("center_id", rounded("accuracy"), rounded("recall")), path)
    return spark.read.option("header", True).schema("center_id int, accuracy double, recall double").csv(path)


@query(
    "snk_2_history",
    f"""WITH {V.HISTORY} SELECT run, round, phase, metric, count(*) AS n, round(avg(value), 6) AS value
        FROM history GROUP BY ALL""",
)
def history_sink(spark, folder):
    path = scratch_path(spark, "history")
    metrics = V.round_history(spark, folder)
    for half in (0, 1):
        sinks.append_history(metrics.where(F.col("round") % 2 == half), path)
    back = spark.read.parquet(path)
    return back.groupBy("run", "round", "phase", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("value")
    )


@query("snk_3_model_checkpoint")
def model_checkpoint(spark, folder):
    from centrum.plans.rounds import linear_rounds
    from centrum.queries.models import CHECKPOINTS

    path = scratch_path(spark, "linear-rounds")
    for round_no, shared, _ in linear_rounds(V.planted_features(spark, folder), V.WIDTH, num_rounds=CHECKPOINTS):
        sinks.write_model_round(shared, path, round_no)
    back = sinks.read_model_rounds(spark, path)
    return back.select("round", F.size("coef").alias("width"), rounded("intercept"))


@query(
    "proj_1_binarize_target",
    f"WITH {V.PLANTED} SELECT row_key, cast(y > (SELECT median(y) FROM planted) AS double) AS label FROM planted",
)
def binarize_target(spark, folder):
    rows = V.planted_rows(spark, folder).select("row_key", "y")
    return targets.binarized(rows, "y").select("row_key", "label")


@query(
    "proj_2_task_type",
    f"""WITH {V.PLANTED}, n AS (
          SELECT 'label' AS source, count(DISTINCT label) AS n_labels FROM planted UNION ALL
          SELECT 'l_quantity', count(DISTINCT l_quantity) FROM planted UNION ALL
          SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM planted)
        SELECT source, n_labels, CASE WHEN n_labels = 2 THEN 'BINARY' WHEN n_labels > 2 AND n_labels < 100 THEN 'MULTICLASS' ELSE 'REG' END AS task_type
        FROM n""",
)
def task_type(spark, folder):
    return targets.task_types(V.planted_rows(spark, folder), ["label", "l_quantity", "l_extendedprice"])


@query(
    "proj_3_recode_labels",
    f"WITH {V.PLANTED} SELECT row_key, label FROM planted",
)
def recode_labels(spark, folder):
    p = V.planted_rows(spark, folder)
    signed = p.select("row_key", F.when(F.col("label") == 1, 1).otherwise(-1).alias("sign"))
    return signed.select("row_key", C.recode_negative(F.col("sign")).alias("label"))


@query("proj_4_choose_columns", f"WITH {V.PLANTED} SELECT l_tax, l_quantity, label FROM planted")
def choose_columns(spark, folder):
    return readers.select_features(V.planted_rows(spark, folder), "label", ["l_tax", "l_quantity"])


@query(
    "proj_5_to_number",
    "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE cast(value AS varchar) END AS double) AS number FROM events",
)
def to_number(spark, folder):
    e = V.table(spark, folder, "events")
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", C.number_or_null(mixed).alias("number"))


@query("proj_6_positive_probability", f"WITH {V.SCORED} SELECT row_key, score AS p_pair, score AS p_single FROM scored")
def positive_probability(spark, folder):
    s = V.scored_rows(spark, folder).withColumn("pair", F.array(1 - F.col("score"), F.col("score")))
    return s.select(
        "row_key",
        C.positive_probability(F.col("pair"), True).alias("p_pair"),
        C.positive_probability(F.col("score"), False).alias("p_single"),
    )


@query(
    "proj_7_hard_label",
    f"WITH {V.SCORED} SELECT row_key, cast(score >= 0.1e0 AS integer) AS at_least, cast(score > 0.1e0 AS integer) AS above FROM scored",
)
def hard_labels(spark, folder):
    s = V.scored_rows(spark, folder)
    return s.select(
        "row_key",
        C.hard_label(F.col("score"), 0.1, inclusive=True).alias("at_least"),
        C.hard_label(F.col("score"), 0.1).alias("above"),
    )


@query(
    "proj_8_clean_keys",
    f"""WITH {V.SCORED} SELECT split || ' ' || replace(trim('  ' || "user tier" || ' '), ' ', '_') AS name, count(*) AS n
        FROM scored GROUP BY 1""",
)
def clean_keys(spark, folder):
    s = V.scored_rows(spark, folder)
    key = C.clean_key(F.concat(F.lit("  "), F.col("user tier"), F.lit(" ")))
    return s.groupBy(F.concat_ws(" ", "split", key).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_9_group_letters",
    f"""WITH {V.PLANTED}, g AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM planted GROUP BY ALL),
       r AS (SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i FROM g)
       SELECT l_returnflag, l_quantity, n, CASE WHEN i < 26 THEN chr(cast(65 + i AS integer)) ELSE 'G' || cast(i + 1 AS varchar) END AS letter FROM r""",
)
def group_letters(spark, folder):
    g = V.planted_rows(spark, folder).groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    place = F.dense_rank().over(Window.partitionBy("l_returnflag").orderBy("l_quantity")) - 1
    return g.withColumn("letter", C.group_letter(place))


@query(
    "proj_11_display_rounding",
    f"""WITH {V.PLANTED}, a AS (SELECT l_quantity, l_tax, avg(label) AS m FROM planted GROUP BY ALL)
        SELECT l_quantity, l_tax, round_even(m, 3) AS m3, round_even(m, 2) AS m2 FROM a""",
)
def display_rounding(spark, folder):
    a = V.planted_rows(spark, folder).groupBy("l_quantity", "l_tax").agg(F.avg("label").alias("m"))
    return a.select("l_quantity", "l_tax", F.bround("m", 3).alias("m3"), F.bround("m", 2).alias("m2"))
