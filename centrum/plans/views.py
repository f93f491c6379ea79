"""Views of the given tables that stand for the inputs of the operators, each as a DataFrame and as a SQL view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from centrum.functions.columns import row_hash


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_hash(key: str, *salt) -> str:
    """The row hash in SQL; salts are literals, or SQL expressions given as (expression,)."""
    parts = [f"cast({s[0]} as varchar)" if isinstance(s, tuple) else f"'{s}'" for s in salt]
    return f"cast('0x' || substr(md5(concat_ws(':', {', '.join([*parts, f'cast({key} as varchar)'])})), 1, 8) as bigint)"


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]
WIDTH = 4


def planted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items in ten centers; the label follows from the features."""
    raw = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in parts], F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return raw.select(
        key.alias("row_key"),
        (F.col("l_suppkey") % 10).cast("int").alias("center_id"),
        *NUMERIC,
        *TEXT,
        price.alias("y"),
        (price > 50000.0).cast("double").alias("label"),
        ((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)).cast("double").alias("label2"),
    )


def planted_features(spark: SparkSession, folder: str, label: str = "label") -> DataFrame:
    """The same rows with their four numbers in one array, each brought to about 0..1."""
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    return planted_rows(spark, folder).select("row_key", "center_id", x.alias("features"), F.col(label).alias("label"))


PLANTED = """planted AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) AS bigint)) AS row_key,
         cast(l_suppkey % 10 AS integer) AS center_id,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         l_extendedprice * (1 - l_discount) AS y,
         cast(l_extendedprice * (1 - l_discount) > 50000 AS double) AS label,
         cast(l_quantity > 25 AND l_discount > 0.05e0 AS double) AS label2,
         l_quantity / 50e0 AS f0, l_extendedprice / 100000e0 AS f1, l_discount * 10e0 AS f2, l_tax * 10e0 AS f3
  FROM lineitem)"""


def clinic_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer in five centers; centers 1 to 4 have nulls."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    h, center = row_hash("o_orderkey", 42), (F.col("c_nationkey") % 5).cast("int")
    missing = lambda step: (h % step == 0) & (center != 0)
    return joined.select(
        F.col("o_orderkey").cast("string").alias("row_key"),
        center.alias("center_id"),
        F.when(~missing(13), F.col("o_totalprice")).alias("o_totalprice"),
        "c_acctbal",
        F.when(~missing(17), F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_mktsegment",
        (F.col("o_orderstatus") == "F").cast("double").alias("label"),
    )


CLINIC = f"""clinic AS (
  SELECT cast(o_orderkey AS varchar) AS row_key, cast(c_nationkey % 5 AS integer) AS center_id,
         CASE WHEN {sql_hash('o_orderkey', 42)} % 13 = 0 AND c_nationkey % 5 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         c_acctbal,
         CASE WHEN {sql_hash('o_orderkey', 42)} % 17 = 0 AND c_nationkey % 5 <> 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         c_mktsegment, cast(o_orderstatus = 'F' AS double) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def site_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents; the center is named by their source."""
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = d.join(table(spark, folder, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("row_key"),
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        F.col("quality").cast("double").alias("label"),
        F.col("toxic").cast("int").alias("toxic"),
        F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"),
    )


SITE = """site AS (
  SELECT cast(doc_id AS varchar) AS row_key, source, cast(n_chars AS double) AS n_chars, lang,
         cast(quality AS double) AS label, cast(toxic AS integer) AS toxic, least(n_chars / 5000e0, 1e0) AS score
  FROM documents JOIN labels USING (doc_id))"""


def array_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as array features with ten classes."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_key"),
        "vec_id",
        (F.col("vec_id") % 5).cast("int").alias("center_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored predictions, with a two-group and a three-group attribute and a split."""
    h = row_hash("event_id", 7)
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("row_key"),
        "event_id",
        (F.col("user_id") % 10).cast("int").alias("center_id"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"),
        (F.col("event_type") == "purchase").cast("double").alias("label"),
        F.when(h % 2 == 0, "even").otherwise("odd").alias("parity"),
        F.concat(F.lit("tier "), (F.col("user_id") % 3).cast("string")).alias("user tier"),
        F.when(h % 5 == 0, "test").when(h % 5 == 1, "val").otherwise("train").alias("split"),
    )


SCORED = f"""scored AS (
  SELECT cast(event_id AS varchar) AS row_key, event_id, cast(user_id % 10 AS integer) AS center_id,
         least(value / 500e0, 1e0) AS score, cast(event_type = 'purchase' AS double) AS label,
         CASE WHEN {sql_hash('event_id', 7)} % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
         'tier ' || cast(user_id % 3 AS varchar) AS "user tier",
         CASE {sql_hash('event_id', 7)} % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split
  FROM events)"""

PHASES = ["val", "test", "local", "personalized"]
HISTORY_METRICS = ["accuracy", "balanced_accuracy", "f1", "precision", "recall", "specificity"]


def round_history(spark: SparkSession, folder: str) -> DataFrame:
    """A history of 5 runs x 10 rounds x 4 phases x 10 centers taken from the scored rows."""
    from centrum.operators.metrics import confusion, with_rates

    e = F.col("event_id")
    rows = scored_rows(spark, folder).select(
        (e % 5).cast("int").alias("run"),
        (F.floor(e / 5) % 10).cast("int").alias("round"),
        F.element_at(F.array(*[F.lit(p) for p in PHASES]), (F.floor(e / 50) % 4 + 1).cast("int")).alias("phase"),
        "center_id",
        "score",
        "label",
    )
    keys = ["run", "round", "phase", "center_id"]
    wide = with_rates(confusion(rows, keys, 0.1)).withColumn("n_rows", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in HISTORY_METRICS])
    return wide.select(*keys, "n_rows", F.explode(entries).alias("_m")).select(*keys, "_m.metric", "_m.value", "n_rows")


def sql_rates(suffix: str = "") -> str:
    """The rates in SQL from tp, fp, tn, fn."""
    return """CASE WHEN tp+fp+tn+fn > 0 THEN (tp+tn)/cast(tp+fp+tn+fn AS double) ELSE 0 END AS accuracy,
         CASE WHEN tp+fp > 0 THEN tp/cast(tp+fp AS double) ELSE 0 END AS precision,
         CASE WHEN tp+fn > 0 THEN tp/cast(tp+fn AS double) ELSE 0 END AS recall,
         CASE WHEN tn+fp > 0 THEN tn/cast(tn+fp AS double) ELSE 0 END AS specificity,
         CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/cast(2*tp+fp+fn AS double) ELSE 0 END AS f1,
         (CASE WHEN tp+fn > 0 THEN tp/cast(tp+fn AS double) ELSE 0 END
          + CASE WHEN tn+fp > 0 THEN tn/cast(tn+fp AS double) ELSE 0 END)/2e0 AS balanced_accuracy"""


def sql_confusion(threshold: str) -> str:
    """Confusion counts in SQL."""
    return f"""count(*) FILTER (score > {threshold} AND label = 1) AS tp, count(*) FILTER (score > {threshold} AND label = 0) AS fp,
         count(*) FILTER (score <= {threshold} AND label = 0) AS tn, count(*) FILTER (score <= {threshold} AND label = 1) AS fn"""


HISTORY = f"""{SCORED}, hraw AS (
  SELECT cast(event_id % 5 AS integer) AS run, cast((event_id // 5) % 10 AS integer) AS round,
         CASE (event_id // 50) % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'local' ELSE 'personalized' END AS phase,
         center_id, score, label FROM scored),
hcount AS (SELECT run, round, phase, center_id, {sql_confusion('0.1e0')} FROM hraw GROUP BY ALL),
hwide AS (SELECT run, round, phase, center_id, tp+fp+tn+fn AS n_rows, {sql_rates()} FROM hcount),
history AS (SELECT run, round, phase, center_id, metric, value, n_rows FROM hwide
  UNPIVOT (value FOR metric IN ({', '.join(HISTORY_METRICS)})))"""


def center_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts and a cost per planted center."""
    return planted_rows(spark, folder).groupBy("center_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("cost")
    )


STATS = f"""{PLANTED}, stats AS (
  SELECT center_id, count(*) AS n_rows, sum(l_quantity) AS cost FROM planted GROUP BY center_id)"""
