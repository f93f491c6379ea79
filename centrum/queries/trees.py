"""Boosted and random trees: growth, encoding, scoring and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from centrum.operators import forests, linear, merge, trees as tr
from centrum.operators.ordering import settle
from centrum.plans import rounds, views as V
from centrum.queries.registry import finished, query, rounded

BINS, RATE = 16, 0.3


def stumps(spark, folder, label: str = "label", symmetric: bool = False, round_no: int = 1):
    """One tree of depth 1 per center from a margin of 0."""
    rows = V.planted_features(spark, folder, label).withColumn("margin", F.lit(0.0))
    edges = settle(tr.bin_edges(rows, V.WIDTH))
    graded = tr.logistic_gradients(tr.with_bins(rows, edges, V.WIDTH, BINS))
    return tr.grow(graded, edges, V.WIDTH, 1, BINS, RATE, symmetric=symmetric, round_no=round_no)


def sql_stumps(prefix: str = "", label: str = "label", source: str = "planted", rate: float = RATE, g: str = "", h: str = "0.25e0", alpha: float = 0, floor: float = 0) -> str:
    """The same stumps in SQL: histogram, running sums, best gain, three node rows. Edges come from all planted rows."""
    p, g = prefix, g or f"0.5e0 - {label}"
    t = lambda x: f"(sign({x}) * greatest(abs({x}) - {alpha}e0, 0))" if alpha else f"({x})"
    long = lambda table: " UNION ALL ".join(f"SELECT center_id, {i} AS feature, f{i} AS v, {g} AS g, {h} AS h FROM {table}" for i in range(4))
    return f"""{p}lg AS ({long(source)}), {p}ed AS (SELECT center_id, feature, min(v) AS lo, max(v) AS hi FROM ({long("planted")}) GROUP BY ALL),
    {p}hs AS (SELECT l.center_id, l.feature, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {BINS})), {BINS - 1}) ELSE 0 END AS bin,
           sum(g) AS g, sum(h) AS h FROM {p}lg l JOIN {p}ed e ON e.center_id = l.center_id AND e.feature = l.feature GROUP BY ALL),
    {p}cu AS (SELECT center_id, feature, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht FROM {p}hs
           WINDOW u AS (PARTITION BY center_id, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY center_id, feature)),
    {p}ga AS (SELECT *, {t('gl')}*{t('gl')}/(hl+1) + {t('gt-gl')}*{t('gt-gl')}/(ht-hl+1) - {t('gt')}*{t('gt')}/(ht+1) AS gain FROM {p}cu WHERE hl >= 1 AND ht - hl >= 1),
    {p}be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY round(gain, 9) DESC, feature, bin) AS rn
           FROM {p}ga WHERE round(gain, 9) > {floor}) WHERE rn = 1),
    {p}sp AS (SELECT b.*, lo + (bin + 1) * ((hi - lo) / {BINS}) AS thr, -{rate}e0 * {t('gl')} / (hl + 1) AS vl, -{rate}e0 * {t('gt - gl')} / (ht - hl + 1) AS vr
           FROM {p}be b JOIN {p}ed e ON e.center_id = b.center_id AND e.feature = b.feature),
    {p}nodes AS (SELECT center_id, 0 AS node_id, feature, thr AS threshold, 1 AS "left", 2 AS "right", 0e0 AS value, ht AS sum_hessian FROM {p}sp
      UNION ALL SELECT center_id, 1, -1, NULL, -1, -1, vl, hl FROM {p}sp UNION ALL SELECT center_id, 2, -1, NULL, -1, -1, vr, ht - hl FROM {p}sp)"""


STUMPS = f"{V.PLANTED}, {sql_stumps()}"
NODE_COLUMNS = ["center_id", "node_id", "feature", "left", "right"]
SQL_NODES = 'center_id, node_id, feature, "left", "right", round(threshold, 6) AS threshold, round(value, 6) AS value'


def node_rows(trees, *extra):
    return trees.select(*NODE_COLUMNS, rounded("threshold"), rounded("value"), *extra)


@query("trn_9_boost_stump", f"WITH {STUMPS} SELECT {SQL_NODES}, round(sum_hessian, 6) AS sum_hessian FROM nodes")
def boost_stump(spark, folder):
    return node_rows(stumps(spark, folder), rounded("sum_hessian"))


@query("trn_11_symmetric_stump", f"WITH {V.PLANTED}, {sql_stumps('', 'label2')} SELECT {SQL_NODES} FROM nodes")
def symmetric_stump(spark, folder):
    return node_rows(stumps(spark, folder, "label2", symmetric=True))


HALF = 2**31
SUBSAMPLE = lambda t: f"half{t} AS (SELECT * FROM planted WHERE {V.sql_hash('row_key', 42, 3, t)} < {HALF})"


@query(
    "trn_9_parallel_stumps",
    f"""WITH {V.PLANTED}, {SUBSAMPLE(0)}, {SUBSAMPLE(1)}, {sql_stumps('a', 'label2', 'half0', RATE / 2)}, {sql_stumps('b', 'label2', 'half1', RATE / 2)}
        SELECT 5 AS tree_id, {SQL_NODES} FROM anodes UNION ALL SELECT 6, {SQL_NODES} FROM bnodes""",
)
def parallel_stumps(spark, folder):
    """Two trees of the third round, each on its own half of the rows and with half the step."""
    rows = V.planted_features(spark, folder, "label2").withColumn("margin", F.lit(0.0))
    edges = settle(tr.bin_edges(rows, V.WIDTH))
    graded = tr.logistic_gradients(tr.with_bins(rows, edges, V.WIDTH, BINS))
    grown = tr.grow_parallel(graded, edges, V.WIDTH, 1, 2, "row_key", 0.5, 42, RATE, 3, bins=BINS)
    return node_rows(grown, "tree_id")


@query("trn_10_warm_up", f"WITH {V.PLANTED} SELECT center_id, count(*) AS n_rows, 0 AS num_trees FROM planted GROUP BY 1")
def warm_up(spark, folder):
    """The first boosting round shares no trees: it only reports the centers' sizes."""
    sizes = V.planted_rows(spark, folder).groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = merge.tree_counts(tr.no_trees(spark)).select("center_id", F.col("n_trees").alias("num_trees"))
    return sizes.join(counts, "center_id", "left").select("center_id", "n_rows", F.coalesce("num_trees", F.lit(0)).alias("num_trees"))


def clinic_features(spark, folder):
    rows = V.clinic_rows(spark, folder)
    x = F.array(F.coalesce(F.col("o_totalprice") / 100000.0, F.lit(0.0)), F.col("c_acctbal") / 10000.0)
    late = (F.col("o_totalprice") > 150000.0) & (F.col("c_acctbal") > 0)
    return rows.select("row_key", "center_id", x.alias("features"), F.coalesce(late, F.lit(False)).cast("double").alias("label"))


def forest_report(trees):
    return trees.groupBy("round", "center_id").agg(
        F.count_distinct("tree_id").alias("n_trees"), F.count(F.lit(1)).alias("n_nodes"), F.round(F.max("value"), 4).alias("top_value")
    )


TREES, DEPTH = 300, 10


@query("trn_7_forest")
def forest(spark, folder):
    return forest_report(forests.forest_round(clinic_features(spark, folder), "row_key", TREES, DEPTH, width=2))


@query("trn_8_balanced_forest")
def balanced_forest(spark, folder):
    return forest_report(forests.forest_round(clinic_features(spark, folder), "row_key", TREES, DEPTH, balance=True, width=2))


def sql_mixed(name: str, x: str, salt: str, rest: str, source: str) -> str:
    """Named views that add the column ``name``: the 32-bit mix of ``x`` and ``salt``."""
    word, (a, b, c) = 1 << 32, forests.MIX
    return f"""{name}_1 AS (SELECT {rest}, (xor(cast({x} AS ubigint), (cast({salt} AS ubigint) * {a}) % {word}) * {b}) % {word} AS m FROM {source}),
      {name}_2 AS (SELECT * REPLACE ((xor(m, m >> 13) * {c}) % {word} AS m) FROM {name}_1),
      {name} AS (SELECT * EXCLUDE (m), xor(m, m >> 16) AS {name} FROM {name}_2)"""


def sql_bag(rows: str) -> str:
    """Rows by the trees of a forest with their count in each bag; ``rows`` has a column h."""
    steps = " + ".join(f"cast(bag_hash >= {int(t)} AS integer)" for t in forests.poisson_steps(1.0))
    return f"""{sql_mixed('bag_hash', 'h', 'tree_id + 1', '*', f'{rows}, (SELECT cast(range AS integer) AS tree_id FROM range({TREES}))')},
      bag AS (SELECT *, {steps} AS often FROM bag_hash)"""


CLINIC_ROOT = f"""clinic_h AS (SELECT center_id, {V.sql_hash('row_key', 42)} AS h,
  coalesce(cast(o_totalprice > 150000 AND c_acctbal > 0 AS integer), 0) AS label FROM clinic)"""


@query(
    "trn_7_forest_roots",
    f"""WITH {V.CLINIC}, {CLINIC_ROOT}, {sql_bag('clinic_h')}
        SELECT center_id, tree_id, cast(sum(often) FILTER (label = 0) AS bigint) AS n0, cast(sum(often) FILTER (label = 1) AS bigint) AS n1 FROM bag GROUP BY ALL""",
)
def forest_roots(spark, folder):
    """Class counts in the bags of the same forest's trees, as their roots report them."""
    nodes = forests.forest_nodes(clinic_features(spark, folder), "row_key", 2, TREES, DEPTH)
    return nodes.where("node_id = 0").select("center_id", "tree_id", "n0", "n1")


ROOT_BINS = 64
ROOT_SPLITS = f"""WITH {V.PLANTED}, rows_h AS (SELECT center_id, l_quantity AS x0, l_discount AS x1, l_tax AS x2, cast(label2 AS integer) AS label, {V.sql_hash('row_key', 42)} AS h FROM planted),
  places AS (SELECT * FROM (SELECT DISTINCT center_id FROM rows_h), (SELECT cast(range AS integer) AS tree_id FROM range({TREES})), (SELECT cast(range AS integer) AS feature FROM range(3))),
  {sql_mixed('s1', 'center_id', '42', '*', 'places')}, {sql_mixed('s2', 's1', 'tree_id + 1', '*', 's1')}, {sql_mixed('s3', 's2', '1', '*', 's2')}, {sql_mixed('s4', 's3', 'feature + 1', '*', 's3')},
  picked AS (SELECT center_id, tree_id, arg_min(feature, s4) AS feature FROM s4 GROUP BY ALL),
  {sql_bag('rows_h')},
  values_of AS (SELECT center_id, 0 AS feature, x0 AS v FROM rows_h UNION SELECT center_id, 1, x1 FROM rows_h UNION SELECT center_id, 2, x2 FROM rows_h),
  nexts AS (SELECT center_id, feature, v, lead(v) OVER (PARTITION BY center_id, feature ORDER BY v) AS threshold FROM values_of),
  weights AS (SELECT center_id, count(*) / (2e0 * count(*) FILTER (label = 0)) AS w0, count(*) / (2e0 * count(*) FILTER (label = 1)) AS w1 FROM rows_h GROUP BY 1),
  hist AS (SELECT b.center_id, tree_id, feature, CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS v, sum(often) FILTER (label = 0) AS c0, sum(often) FILTER (label = 1) AS c1
    FROM bag b JOIN picked USING (center_id, tree_id) WHERE often > 0 GROUP BY ALL),
  cum AS (SELECT center_id, tree_id, feature, v, coalesce(sum(c0) OVER u, 0) AS l0, coalesce(sum(c1) OVER u, 0) AS l1, coalesce(sum(c0) OVER p, 0) AS t0, coalesce(sum(c1) OVER p, 0) AS t1 FROM hist
    WINDOW p AS (PARTITION BY center_id, tree_id), u AS (PARTITION BY center_id, tree_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
  mass AS (SELECT cum.*, l0 * w0 AS a0, l1 * w1 AS a1, (t0 - l0) * w0 AS b0, (t1 - l1) * w1 AS b1, t0 * w0 AS m0, t1 * w1 AS m1 FROM cum JOIN weights USING (center_id) WHERE t0 + t1 > l0 + l1),
  gains AS (SELECT *, round((a0*a0 + a1*a1) / (a0 + a1) + (b0*b0 + b1*b1) / (b0 + b1) - (m0*m0 + m1*m1) / (m0 + m1), 9) AS gain FROM mass)
SELECT center_id, tree_id, feature, threshold, cast(t0 AS bigint) AS n0, cast(t1 AS bigint) AS n1, round(gain, 6) AS gain FROM gains JOIN nexts USING (center_id, feature, v) WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY center_id, tree_id ORDER BY gain DESC, v) = 1"""


@query("trn_7_root_splits", ROOT_SPLITS)
def root_splits(spark, folder):
    """The first split of every tree, over features whose values are all cut points."""
    rows = V.planted_rows(spark, folder).select("row_key", "center_id", F.array("l_quantity", "l_discount", "l_tax").alias("features"), F.col("label2").alias("label"))
    nodes = forests.forest_nodes(rows, "row_key", 3, TREES, 1, bins=ROOT_BINS)
    return nodes.where("node_id = 0 and feature >= 0").select("center_id", "tree_id", "feature", "threshold", "n0", "n1", rounded("gain"))


@query("trn_14_local_ensembles")
def local_ensembles(spark, folder):
    rows = V.planted_features(spark, folder, "label2")
    grown = rounds.train_boosted(
        rows, V.WIDTH, num_rounds=3, depth=8, rate=0.1, merged=False, subsample=0.8, key="row_key", scale_positive=50.0, min_gain=5.0, reg_alpha=5.0
    )
    return forest_report(grown)


FLAG_NUMBER = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def flag_features(spark, folder):
    """The planted rows with three classes."""
    rows = V.planted_rows(spark, folder)
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    number = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return rows.select("row_key", "center_id", x.alias("features"), number.alias("label"))


THIRD = repr(1 / 3)
CLASS_STUMPS = ", ".join(sql_stumps(f"c{k}", g=f"{THIRD}e0 - cast({FLAG_NUMBER} = {k} AS integer)", h=f"{THIRD}e0 * (1 - {THIRD}e0)") for k in range(3))


@query(
    "trn_14_multiclass_round",
    f"WITH {V.PLANTED}, {CLASS_STUMPS} " + " UNION ALL ".join(f"SELECT cast({k} AS integer) AS class_no, {k + 1} AS tree_id, {SQL_NODES} FROM c{k}nodes" for k in range(3)),
)
def multiclass_round(spark, folder):
    """One round of softmax boosting: a stump for each center and class."""
    rows = flag_features(spark, folder)
    _, grown = next(rounds.class_rounds(rows, V.WIDTH, 3, 1, 1, BINS, RATE, merged=False, equal_width=True))
    return node_rows(grown, "class_no", "tree_id")


@query("trn_14_regression_round", f"WITH {V.PLANTED}, {sql_stumps(g='0 - y / 100000e0', h='1e0')} SELECT {SQL_NODES} FROM nodes")
def regression_round(spark, folder):
    """One round of squared-loss boosting on the price."""
    rows = V.planted_features(spark, folder).drop("label").join(
        V.planted_rows(spark, folder).select("row_key", (F.col("y") / 100000.0).alias("label")).dropDuplicates(["row_key"]), "row_key"
    )
    _, grown = next(rounds.boosted_rounds(rows, V.WIDTH, 1, 1, BINS, RATE, merged=False, objective="squared", equal_width=True))
    return node_rows(grown)


@query("trn_14_penalised_round", f"WITH {V.PLANTED}, {sql_stumps(label='label2', alpha=5, floor=5)} SELECT {SQL_NODES} FROM nodes")
def penalised_round(spark, folder):
    """One round with an L1 penalty of 5 on leaves and a gain floor of 5."""
    rows = V.planted_features(spark, folder, "label2")
    _, grown = next(rounds.boosted_rounds(rows, V.WIDTH, 1, 1, BINS, RATE, merged=False, equal_width=True, reg_alpha=5.0, min_gain=5.0))
    return node_rows(grown).where("left > 0 or node_id > 0")


def sql_oblivious(label: str, depth: int) -> str:
    """Oblivious trees in SQL, level by level: gains are summed over a level's nodes before the best cut is taken."""
    bin_of = lambda i: f"cast(CASE WHEN hi{i} > lo{i} THEN least(floor((f{i} - lo{i}) / ((hi{i} - lo{i}) / {BINS})), {BINS - 1}) ELSE 0 END AS integer)"
    ends = ", ".join(f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(4))
    parts = [f"ends AS (SELECT center_id, {ends} FROM planted GROUP BY 1)",
             f"lv0 AS (SELECT center_id, 0 AS node, 0.5e0 - {label} AS g, 0.25e0 AS h, {', '.join(f'{bin_of(i)} AS b{i}' for i in range(4))} FROM planted JOIN ends USING (center_id))"]
    for l in range(depth):
        each = " UNION ALL ".join(f"SELECT center_id, node, {i} AS feature, b{i} AS bin, g, h FROM lv{l}" for i in range(4))
        parts += [
            f"hs{l} AS (SELECT center_id, node, feature, bin, sum(g) AS g, sum(h) AS h FROM ({each}) GROUP BY ALL)",
            f"""cu{l} AS (SELECT center_id, node, feature, cast(b AS integer) AS bin, coalesce(sum(g) FILTER (bin <= b), 0) AS gl, coalesce(sum(h) FILTER (bin <= b), 0) AS hl, sum(g) AS gt, sum(h) AS ht
              FROM hs{l}, range({BINS - 1}) r(b) GROUP BY ALL)""",
            f"ga{l} AS (SELECT *, gl*gl/(hl+1) + (gt-gl)*(gt-gl)/(ht-hl+1) - gt*gt/(ht+1) AS gain FROM cu{l})",
            f"""be{l} AS (SELECT center_id, feature, bin FROM (SELECT center_id, feature, bin, sum(gain) AS gain FROM ga{l} GROUP BY ALL) WHERE round(gain, 9) > 0
              QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY round(gain, 9) DESC, feature, bin) = 1)""",
            f"sp{l} AS (SELECT ga{l}.* FROM ga{l} JOIN be{l} USING (center_id, feature, bin))",
            f"""lv{l + 1} AS (SELECT v.* REPLACE (2 * node + 1 + cast(CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END > bin AS integer) AS node)
              FROM lv{l} v JOIN be{l} USING (center_id))""",
        ]
    lo, hi = ("CASE feature " + " ".join(f"WHEN {i} THEN {e}{i}" for i in range(4)) + " END" for e in ("lo", "hi"))
    inner = " UNION ALL ".join(f"SELECT * FROM sp{l}" for l in range(depth))
    parts.append(f"sp AS ({inner})")
    leaf = lambda k, g, h: f"SELECT center_id, 2 * node + {k}, -1, NULL, -1, -1, -{RATE}e0 * ({g}) / ({h} + 1) FROM sp WHERE (center_id, 2 * node + {k}) NOT IN (SELECT center_id, node FROM sp)"
    parts.append(f"""nodes AS (SELECT center_id, node AS node_id, feature, {lo} + (bin + 1) * (({hi} - {lo}) / {BINS}) AS threshold, 2 * node + 1 AS "left", 2 * node + 2 AS "right", 0e0 AS value FROM sp JOIN ends USING (center_id)
      UNION ALL {leaf(1, 'gl', 'hl')} UNION ALL {leaf(2, 'gt - gl', 'ht - hl')})""")
    return ", ".join(parts)


@query("trn_11_oblivious_trees", f"WITH {V.PLANTED}, {sql_oblivious('label2', 3)} SELECT {SQL_NODES} FROM nodes")
def oblivious_trees(spark, folder):
    """Oblivious trees of depth 3: one cut for all nodes of a level."""
    _, grown = next(rounds.boosted_rounds(V.planted_features(spark, folder, "label2"), V.WIDTH, 1, 3, BINS, RATE, symmetric=True, merged=False, equal_width=True))
    return node_rows(grown)


ENCODED = f"""{STUMPS}, encoded AS (SELECT p.row_key, p.center_id, p.label, s.center_id AS pos,
  CASE WHEN (CASE feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END) < thr THEN vl ELSE vr END AS v FROM planted p, sp s)"""


@query("trn_15_tree_encoding", f"WITH {ENCODED} SELECT row_key, round(v, 6) AS value, cast(pos AS integer) AS pos FROM encoded")
def tree_encoding(spark, folder):
    rows = V.planted_features(spark, folder).select("row_key", "features")
    encoded = tr.encode_trees(rows, stumps(spark, folder))
    return encoded.select("row_key", F.posexplode("tree_out").alias("pos", "value")).select("row_key", "pos", rounded("value"))


@query(
    "trn_16_head_step",
    f"""WITH {ENCODED}, cw AS (SELECT center_id, label, sum(count(*)) OVER (PARTITION BY center_id) / (2e0 * count(*)) AS weight FROM planted GROUP BY center_id, label),
        n AS (SELECT center_id, count(*) AS n FROM planted GROUP BY 1)
        SELECT e.center_id, cast(pos AS integer) AS pos, round(-0.5e0 * sum(weight * (0.5e0 - e.label) * v) / any_value(n), 6) AS value
        FROM encoded e JOIN cw ON cw.center_id = e.center_id AND cw.label = e.label JOIN n ON n.center_id = e.center_id GROUP BY ALL""",
)
def head_step(spark, folder):
    """One step of the model on the encoded rows: a learned rate per tree."""
    rows = V.planted_features(spark, folder)
    trees = stumps(spark, folder)
    encoded = tr.encode_trees(linear.balanced(rows), trees).select("center_id", "label", "weight", F.col("tree_out").alias("features"))
    width = trees.select("center_id", "tree_id").distinct().count()
    models = linear.local_round(encoded, linear.shared_start(rows, width), width, "logistic_regression", 0.5)
    return merge.parameter_rows(models).where("pos >= 0").select("center_id", "pos", rounded("value"))


@query("scr_2_forest_score", f"WITH {ENCODED} SELECT row_key, round(avg(v), 6) AS score FROM encoded GROUP BY 1")
def forest_score(spark, folder):
    rows = V.planted_features(spark, folder).select("row_key", "features")
    return tr.score_forest(rows, stumps(spark, folder)).select("row_key", rounded("score"))


SIZES = "wn AS (SELECT center_id, count(*) AS n_rows, count(*) / cast(sum(count(*)) OVER () AS double) AS share FROM planted GROUP BY 1)"


def sizes_of(spark, folder):
    return V.planted_rows(spark, folder).groupBy("center_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "scr_3_boosted_score",
    f"""WITH {ENCODED}, {SIZES} SELECT row_key, round(1e0 / (1e0 + exp(-sum(v * share))), 6) AS score
        FROM encoded JOIN wn ON wn.center_id = pos GROUP BY 1""",
)
def boosted_score(spark, folder):
    rows = V.planted_features(spark, folder).select("row_key", "features")
    rates = merge.step_sizes(sizes_of(spark, folder), 1.0, "weighted")
    scaled = merge.scale_leaves(stumps(spark, folder), rates)
    return tr.score_boosted(rows, scaled).select("row_key", rounded("score"))


@query("scr_5_empty_model", f"WITH {V.PLANTED} SELECT row_key, 0.5e0 AS score FROM planted")
def empty_model(spark, folder):
    rows = V.planted_features(spark, folder).select("row_key", "features")
    return tr.score_boosted(rows, tr.no_trees(spark)).select("row_key", "score")


@query("scr_6_pooled_test")
def pooled_test(spark, folder):
    """The merged model on one pooled test table, without the center key."""
    from centrum.operators.metrics import all_metrics, long_metrics
    from centrum.operators.splits import stratified_split
    from centrum.queries.models import OWN_ROUNDS

    rows = stratified_split(V.planted_features(spark, folder), "row_key").persist()
    shared, _ = rounds.train_linear(rows.where("split = 'train'"), V.WIDTH, num_rounds=OWN_ROUNDS, rate=3.0)
    scored = linear.score_linear(rows.where("split = 'test'"), shared, V.WIDTH)
    return finished(long_metrics(all_metrics(scored, ["split"]), ["split"]).withColumn("value", F.round("value", 4)), rows)


@query("proj_10_shared_trees", f"WITH {STUMPS} SELECT {SQL_NODES} FROM nodes")
def shared_trees(spark, folder):
    shared = merge.without_hessians(stumps(spark, folder))
    return shared.drop("round", "tree_id", "tree_weight").withColumn("value", F.round("value", 6)).withColumn("threshold", F.round("threshold", 6))


INDEX = f"{V.PLANTED}, idx AS (SELECT DISTINCT center_id, cast(l_quantity AS integer) - 1 AS tree_id FROM planted)"


def index(spark, folder):
    """Fifty tree ids per center, taken from the data."""
    return V.planted_rows(spark, folder).select("center_id", (F.col("l_quantity").cast("int") - 1).alias("tree_id")).distinct()


def sql_random_draw(seed: int) -> str:
    return f"""SELECT center_id, draw, ids[{V.sql_hash('draw', seed, ('center_id',))} % n + 1] AS tree_id FROM
      (SELECT center_id, n, ids, cast(unnest(range(n // k)) AS integer) AS draw FROM
        (SELECT center_id, count(*) AS n, list(tree_id ORDER BY tree_id) AS ids, count(*) OVER () AS k FROM idx GROUP BY 1))"""


@query("fed_7_random_draw", f"WITH {INDEX} {sql_random_draw(42)}")
def random_draw(spark, folder):
    return merge.forest_random_draw(index(spark, folder)).select("center_id", "draw", "tree_id")


@query("fed_8_keep_all", f"WITH {INDEX} SELECT center_id, tree_id, row_number() OVER (ORDER BY center_id, tree_id) - 1 AS new_id FROM idx")
def keep_all(spark, folder):
    return merge.renumber(index(spark, folder), ["center_id", "tree_id"])


def sql_weighted_draw(seed: int, draws: int) -> str:
    return f"""(SELECT draw, center_id, tree_id, p AS weight FROM
      (SELECT cast(d AS integer) AS draw, {V.sql_hash('d', seed)} AS u FROM range({draws}) t(d))
      JOIN (SELECT center_id, tree_id, p, coalesce(lag(hi) OVER (ORDER BY center_id, tree_id), 0) AS lo, hi FROM
        (SELECT center_id, tree_id, p, CASE WHEN row_number() OVER (ORDER BY center_id DESC, tree_id DESC) = 1 THEN 4294967296
           ELSE floor(sum(p) OVER (ORDER BY center_id, tree_id ROWS UNBOUNDED PRECEDING) * 4294967296) END AS hi FROM
          (SELECT center_id, tree_id, w / sum(w) OVER () AS p FROM idx JOIN cwt USING (center_id)))) ON u >= lo AND u < hi)"""


CENTER_W = """cwt AS (SELECT center_id, (n / cast(sum(n) OVER () AS double)) * 0.5e0 + (1e0 / count(*) OVER ()) * 0.5e0 AS w
  FROM (SELECT center_id, count(*) AS n FROM planted GROUP BY 1))"""


@query("fed_9_weighted_draw", f"WITH {INDEX}, {CENTER_W} SELECT draw, center_id, tree_id, round(weight, 8) AS weight FROM {sql_weighted_draw(42, 50)}")
def weighted_draw(spark, folder):
    weights = merge.smoothed_weights(sizes_of(spark, folder), "EqualVoting", 0.5)
    return merge.forest_weighted_draw(index(spark, folder), weights, 50).select("draw", "center_id", "tree_id", rounded("weight", 8))


@query(
    "fed_10_accumulated",
    f"""WITH {INDEX}, {CENTER_W}, both_rounds AS (
          SELECT 0 AS part, draw, center_id, tree_id FROM {sql_weighted_draw(1, 50)} UNION ALL
          SELECT 1, draw, center_id, tree_id FROM {sql_weighted_draw(2, 50)})
        SELECT row_number() OVER (ORDER BY part, draw) - 1 AS tree_id, center_id, tree_id AS source_tree FROM both_rounds""",
)
def accumulated(spark, folder):
    weights = merge.smoothed_weights(sizes_of(spark, folder), "EqualVoting", 0.5)
    parts = [
        merge.forest_weighted_draw(index(spark, folder), weights, 50, seed).select(
            F.col("draw").alias("tree_id"), "center_id", F.col("tree_id").alias("source_tree")
        )
        for seed in (1, 2)
    ]
    return merge.accumulate(parts[0], parts[1])


@query(
    "fed_11_bagging",
    f"""WITH {STUMPS}, {sql_stumps('b', 'label2')}, k AS (SELECT count(DISTINCT center_id) AS k FROM nodes),
        m AS (SELECT 1 AS iteration, dense_rank() OVER (ORDER BY center_id) - 1 AS tree_id, * FROM nodes UNION ALL
              SELECT 2, (SELECT k FROM k) + dense_rank() OVER (ORDER BY center_id) - 1, * FROM bnodes)
        SELECT iteration, tree_id, {SQL_NODES} FROM m""",
)
def bagging(spark, folder):
    first = merge.bagging_merge(None, stumps(spark, folder), 1)
    both = merge.bagging_merge(first, stumps(spark, folder, "label2", round_no=2), 2)
    return node_rows(both, "iteration", "tree_id")


@query(
    "fed_12_largest_model",
    f"WITH {STUMPS}, {SIZES} SELECT {SQL_NODES} FROM nodes WHERE center_id = (SELECT center_id FROM wn ORDER BY n_rows DESC, center_id LIMIT 1)",
)
def largest(spark, folder):
    return node_rows(merge.largest_model(stumps(spark, folder), sizes_of(spark, folder)))


@query(
    "fed_13_step_sizes",
    f"""WITH {STUMPS}, {SIZES} SELECT center_id, node_id, round(0.2e0 * share, 8) AS rate, round(value * 0.2e0 * share, 8) AS value
        FROM nodes JOIN wn USING (center_id)""",
)
def step_sizes(spark, folder):
    rates = merge.step_sizes(sizes_of(spark, folder), 0.2, "weighted")
    scaled = merge.scale_leaves(stumps(spark, folder), rates)
    return scaled.join(rates, "center_id").select("center_id", "node_id", rounded("rate", 8), rounded("value", 8))


@query(
    "fed_14_symmetric_merge",
    f"""WITH {STUMPS}, {SIZES}, {sql_stumps('b', 'label2')}
        SELECT 1 AS round, center_id, node_id, 1e0 AS tree_weight, round(value, 6) AS value FROM nodes UNION ALL
        SELECT 2, center_id, node_id, round(share, 6), round(value, 6) FROM bnodes JOIN wn USING (center_id)""",
)
def symmetric_merge(spark, folder):
    merged = merge.symmetric_merge(
        stumps(spark, folder, symmetric=True), stumps(spark, folder, "label2", True, 2), sizes_of(spark, folder)
    )
    return merged.select("round", "center_id", "node_id", rounded("tree_weight"), rounded("value"))


@query("fed_15_newest_trees", f"WITH {V.PLANTED}, {sql_stumps('', 'label2')} SELECT 2 AS round, {SQL_NODES} FROM nodes")
def newest(spark, folder):
    both = stumps(spark, folder).unionByName(stumps(spark, folder, "label2", round_no=2))
    return node_rows(merge.newest(both, 2), "round")


@query(
    "fed_16_encoder_bundle",
    f"WITH {STUMPS} SELECT dense_rank() OVER (ORDER BY center_id) - 1 AS column_no, {SQL_NODES} FROM nodes",
)
def bundle(spark, folder):
    return node_rows(merge.encoder_bundle(stumps(spark, folder)), "column_no")


@query(
    "fed_20_tree_counts",
    f"WITH {INDEX} SELECT cast(tree_id % 3 AS integer) AS round, center_id, count(DISTINCT tree_id) AS n_trees FROM idx GROUP BY ALL",
)
def counts(spark, folder):
    return merge.tree_counts(index(spark, folder).withColumn("round", (F.col("tree_id") % 3).cast("int")))


@query("fed_19_boosted_rounds")
def boosted_rounds(spark, folder):
    from centrum.operators.splits import one_pass_train_val_test

    rows = one_pass_train_val_test(V.planted_features(spark, folder, "label2"), "row_key").persist()
    grown = rounds.train_boosted(rows.where("split = 'train'"), V.WIDTH, num_rounds=4, depth=2, rate=0.5, rate_mode="weighted")
    history = rounds.round_history(tr.score_boosted(rows.where("split <> 'train'"), grown), 4)
    return finished(history.where("metric IN ('auroc', 'balanced_accuracy')").withColumn("value", F.round("value", 4)), rows)
