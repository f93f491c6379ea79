"""Centers and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from centrum.operators import centers as ce, splits as sp
from centrum.plans import views as V
from centrum.queries.registry import query, rounded

H42, H0 = V.sql_hash("row_key", 42), V.sql_hash("row_key", 0)
K = 7


def sql_chunk(rank0: str, n: str, k: int) -> str:
    """The near-equal chunk of a 0-based rank."""
    return f"""cast(CASE WHEN {rank0} < ({n} % {k}) * ({n} // {k} + 1) THEN ({rank0}) // ({n} // {k} + 1)
        ELSE {n} % {k} + ({rank0} - ({n} % {k}) * ({n} // {k} + 1)) // greatest({n} // {k}, 1) END AS integer)"""


RANKED = f"{V.PLANTED}, r AS (SELECT *, row_number() OVER (ORDER BY {H42}, row_key) - 1 AS i, count(*) OVER () AS n FROM planted)"


@query("part_1_iid_centers", f"WITH {RANKED} SELECT row_key, {sql_chunk('i', 'n', K)} AS center_id FROM r")
def iid(spark, folder):
    return ce.iid_centers(V.planted_rows(spark, folder).select("row_key"), "row_key", K)


# Fixed shares for the comparison with SQL, (class, center) -> share: three centers get most of a class each.
SHARES = [(0.0, 0, 0.62), (0.0, 1, 0.3), (0.0, 2, 0.0795), (0.0, 3, 0.0005), (1.0, 0, 0.0001), (1.0, 1, 0.15), (1.0, 2, 0.25), (1.0, 3, 0.5999)]
FLOOR = 10


def shares_table(spark):
    return spark.createDataFrame(SHARES, "label double, center_id int, share double")


def sql_slices(cls: str, shares: list, k: int, seed: int = 42, floor: int = FLOOR) -> str:
    """Whole counts from shares: cut, lifted to the floor, left-overs by hash draw, excess taken from the largest."""
    values = ", ".join(f"({c}, {i}, cast('{s!r}' AS double))" for c, i, s in shares)
    return f"""sz AS (SELECT {cls} AS cls, count(*) AS n FROM base GROUP BY 1),
    sh AS (SELECT * FROM (VALUES {values}) t(cls, center_id, share)),
    c0 AS (SELECT sz.cls, center_id, n, least({floor}, n // {k}) AS fl, greatest(cast(floor(share * n) AS bigint), least({floor}, n // {k})) AS c
           FROM sh JOIN sz ON sz.cls = sh.cls),
    c1 AS (SELECT *, n - sum(c) OVER (PARTITION BY cls) AS diff,
                  coalesce(sum(c - fl) OVER (PARTITION BY cls ORDER BY c DESC, center_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM c0),
    dr AS (SELECT cls, {V.sql_hash('d', seed, ('cls',))} % {k} AS center_id, count(*) AS extra
           FROM (SELECT cls, unnest(range(1, cast(diff AS bigint) + 1)) AS d FROM c1 WHERE center_id = 0 AND diff > 0) GROUP BY ALL),
    c2 AS (SELECT c1.cls, c1.center_id, c - greatest(0, least(c - fl, -diff - taken)) + coalesce(extra, 0) AS m
           FROM c1 LEFT JOIN dr ON dr.cls = c1.cls AND dr.center_id = c1.center_id),
    sl AS (SELECT cls, center_id, cast(sum(m) OVER w - m AS bigint) AS lo, cast(sum(m) OVER w AS bigint) AS hi FROM c2
           WINDOW w AS (PARTITION BY cls ORDER BY center_id))"""


@query(
    "part_2_dirichlet_centers",
    f"""WITH {V.PLANTED}, base AS (SELECT * FROM planted), {sql_slices('label', SHARES, 4)},
        r AS (SELECT row_key, label, row_number() OVER (PARTITION BY label ORDER BY {H42}, row_key) - 1 AS i FROM planted)
        SELECT row_key, label, cast(center_id AS integer) AS center_id FROM r JOIN sl ON cls = label AND i >= lo AND i < hi""",
)
def dirichlet(spark, folder):
    rows = V.planted_rows(spark, folder).select("row_key", "label")
    return ce.dirichlet_centers(rows, "row_key", "label", 4, min_per_class=FLOOR, shares=shares_table(spark)).select(
        "row_key", "label", "center_id"
    )


@query("part_3_count_repair")
def count_repair(spark, folder):
    rows = V.planted_rows(spark, folder)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    shares = ce.dirichlet_shares(sizes, "label", 10, alpha=0.1)
    return ce.slice_counts(sizes, shares, "label", 10, min_per_class=25).select("label", "center_id", "n_rows", "lo", "hi")


FLAGS = {0.0: "A", 1.0: "R", 2.0: "N"}
FLAG_SHARES = [*SHARES, (2.0, 0, 0.25), (2.0, 1, 0.0005), (2.0, 2, 0.7), (2.0, 3, 0.0495)]


@query(
    "part_4_attribute_centers",
    f"""WITH {V.PLANTED}, base AS (SELECT * FROM planted),
        {sql_slices('l_returnflag', [(repr(FLAGS[c]), k, s) for c, k, s in FLAG_SHARES], 4)},
        r AS (SELECT row_key, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {H42}, row_key) - 1 AS i FROM base)
        SELECT row_key, l_returnflag, cast(center_id AS integer) AS center_id FROM r JOIN sl ON cls = l_returnflag AND i >= lo AND i < hi""",
)
def attribute(spark, folder):
    rows = V.planted_rows(spark, folder).select("row_key", "l_linestatus", "l_returnflag")
    shares = spark.createDataFrame([(FLAGS[c], k, s) for c, k, s in FLAG_SHARES], "l_returnflag string, center_id int, share double")
    return ce.attribute_centers(
        rows, "row_key", ["l_linestatus", "l_returnflag"], 1, 4, min_per_class=FLOOR, shares=shares
    ).select("row_key", "l_returnflag", "center_id")


@query(
    "part_5_equal_split",
    f"""WITH {V.PLANTED}, r AS (SELECT row_key, row_number() OVER (ORDER BY {H0}, row_key) - 1 AS i, count(*) OVER () AS n FROM planted)
        SELECT row_key, cast(least(i // greatest(n // {K}, 1), {K - 1}) AS integer) AS center_id FROM r""",
)
def equal(spark, folder):
    return ce.equal_split(V.planted_rows(spark, folder).select("row_key"), "row_key", K)


def sql_by(groups: str, seed) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {V.sql_hash('row_key', seed)}, row_key) AS pos,
        count(*) OVER (PARTITION BY {groups}) AS n FROM planted)"""


@query(
    "part_6_local_holdout",
    f"""WITH {V.PLANTED}, {sql_by('center_id', 0)}
        SELECT row_key, center_id, CASE WHEN pos <= floor(n * 0.15e0) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def holdout(spark, folder):
    return sp.local_holdout(V.planted_rows(spark, folder).select("row_key", "center_id"), "row_key", 0.15)


@query(
    "part_7_kfold",
    f"""WITH {RANKED}, f AS (SELECT row_key, {sql_chunk('i', 'n', 5)} AS fold FROM r)
        SELECT row_key, fold, cast(c AS integer) AS center_id FROM f, range(5) t(c) WHERE c <> fold""",
)
def folds(spark, folder):
    return ce.kfold_centers(V.planted_rows(spark, folder).select("row_key"), "row_key", 5)


CUT = "least(round(n * 0.2e0), n - 1)"


@query(
    "part_8_stratified_split",
    f"""WITH {V.PLANTED}, {sql_by('center_id, label', 42)}
        SELECT row_key, center_id, label, CASE WHEN pos <= {CUT} THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified(spark, folder):
    return sp.stratified_split(V.planted_rows(spark, folder).select("row_key", "center_id", "label"), "row_key")


@query(
    "part_9_train_val_test",
    f"""WITH {V.PLANTED}, {sql_by('center_id, label', 42)}, t AS (SELECT * FROM r WHERE pos > {CUT}),
        v AS (SELECT row_key, center_id, label, row_number() OVER (PARTITION BY center_id, label ORDER BY {V.sql_hash('row_key', 43)}, row_key) AS pos,
              count(*) OVER (PARTITION BY center_id, label) AS n FROM t)
        SELECT row_key, center_id, label, CASE WHEN pos <= {CUT} THEN 'val' ELSE 'train' END AS split FROM v
        UNION ALL SELECT row_key, center_id, label, 'test' FROM r WHERE pos <= {CUT}""",
)
def three_way(spark, folder):
    return sp.train_val_test(V.planted_rows(spark, folder).select("row_key", "center_id", "label"), "row_key")


@query(
    "part_10_shuffle_splits",
    f"""WITH {V.PLANTED}, c AS (SELECT row_key, center_id, label, cast(s AS integer) AS split_no FROM planted, range(3) t(s)),
        r AS (SELECT *, row_number() OVER (PARTITION BY split_no, center_id, label ORDER BY {V.sql_hash('row_key', 42, ('split_no',))}, row_key) AS pos,
              count(*) OVER (PARTITION BY split_no, center_id, label) AS n FROM c)
        SELECT row_key, center_id, label, split_no, CASE WHEN pos <= {CUT} THEN 'val' ELSE 'train' END AS split FROM r""",
)
def shuffles(spark, folder):
    return sp.shuffle_splits(V.planted_rows(spark, folder).select("row_key", "center_id", "label"), "row_key", 3)


@query(
    "part_11_tiny_centers",
    f"""WITH {V.SITE}, s AS (SELECT *, cast(floor(n_chars / 40) AS integer) AS center_id FROM site),
        r AS (SELECT *, row_number() OVER (PARTITION BY center_id, label ORDER BY {H42}, row_key) AS pos, count(*) OVER (PARTITION BY center_id, label) AS n FROM s)
        SELECT center_id, count(*) AS n_rows, count(*) FILTER (pos <= {CUT}) AS n_test FROM r GROUP BY 1""",
)
def tiny(spark, folder):
    rows = V.site_rows(spark, folder).withColumn("center_id", F.floor(F.col("n_chars") / 40).cast("int"))
    split = sp.stratified_split(rows, "row_key")
    return split.groupBy("center_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "test").alias("n_test")
    )


@query("part_12_select_center", f"WITH {V.PLANTED} SELECT row_key, center_id, label FROM planted WHERE center_id = 3")
def one_center(spark, folder):
    return ce.select_center(V.planted_rows(spark, folder).select("row_key", "center_id", "label"), 3)


@query("part_13_center_sizes", f"WITH {V.PLANTED} SELECT center_id, label, count(*) AS n_rows FROM planted GROUP BY ALL")
def sizes(spark, folder):
    return ce.center_sizes(V.planted_rows(spark, folder), by_label=True)


@query(
    "part_14_reference_center",
    f"""WITH {V.PLANTED}, s AS (SELECT center_id, count(*) AS n_rows FROM planted GROUP BY 1)
        (SELECT 'largest' AS method, * FROM s ORDER BY n_rows DESC, center_id LIMIT 1) UNION ALL
        (SELECT 'random', * FROM s ORDER BY {V.sql_hash('center_id', 42)}, center_id LIMIT 1)""",
)
def reference(spark, folder):
    s = ce.center_sizes(V.planted_rows(spark, folder))
    parts = [ce.reference_center(s, m).select(F.lit(m).alias("method"), "center_id", "n_rows") for m in ("largest", "random")]
    return parts[0].unionByName(parts[1])


@query(
    "part_15_class_shares",
    f"""WITH {V.PLANTED}, {sql_by('center_id, label', 42)}, s AS (SELECT CASE WHEN pos <= {CUT} THEN 'test' ELSE 'train' END AS split, label FROM r),
        c AS (SELECT split, label, count(*) AS n_rows FROM s GROUP BY ALL)
        SELECT split, label, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY split), 6) AS share FROM c""",
)
def shares(spark, folder):
    split = sp.stratified_split(V.planted_rows(spark, folder).select("row_key", "center_id", "label"), "row_key")
    return ce.class_shares(split).select("split", "label", "n_rows", rounded("share"))
