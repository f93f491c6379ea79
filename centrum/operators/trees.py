"""Boosted trees of all centers in one job.

A level of every center's tree is one histogram: gradient sums per (center, node, feature, bin), combined on the
map side, after which everything is split-sized. Trees are rows of TREES; node ids are heap numbers (children of n
are 2n+1 and 2n+2); a row goes left when its value is below the threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from centrum.functions.columns import row_hash, sigmoid
from centrum.operators.binning import with_cut_bins
from centrum.operators.ordering import join_params, running_sums, settle

TREES = (
    "round int, center_id int, tree_id int, node_id int, feature int, threshold double, left int, right int, "
    "value double, sum_hessian double, tree_weight double"
)
NODES_PER_PASS = 500_000


def no_trees(spark) -> DataFrame:
    """The empty model: a table of trees without rows."""
    return spark.createDataFrame([], TREES)


def bin_edges(df: DataFrame, width: int) -> DataFrame:
    """Smallest and largest value of every feature per center, as arrays lo and hi."""
    x = F.col("features")
    return df.groupBy("center_id").agg(
        F.array(*[F.min(x[i]) for i in range(width)]).alias("lo"), F.array(*[F.max(x[i]) for i in range(width)]).alias("hi")
    )


def with_bins(df: DataFrame, edges: DataFrame, width: int, bins: int) -> DataFrame:
    """Bin numbers of all features in one array, by cut points if the edges have them, else of equal width; they do not
    depend on how rows are partitioned."""
    if "cuts" in edges.columns:
        return with_cut_bins(df, edges, width)
    joined = join_params(df, edges, "center_id")
    x, lo, hi = F.col("features"), F.col("lo"), F.col("hi")
    places = [
        F.when(hi[i] > lo[i], F.least(F.floor((x[i] - lo[i]) / ((hi[i] - lo[i]) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
        for i in range(width)
    ]
    return joined.withColumn("bins", F.array(*places)).drop("lo", "hi")


def logistic_gradients(df: DataFrame, margin: str = "margin", scale_positive: float = 1.0) -> DataFrame:
    """First and second derivatives of the log loss at the current margin."""
    p = sigmoid(F.col(margin))
    w = F.when(F.col("label") == 1, F.lit(float(scale_positive))).otherwise(F.lit(1.0))
    return df.withColumn("g", w * (p - F.col("label"))).withColumn("h", w * p * (1 - p))


def squared_gradients(df: DataFrame, margin: str = "margin") -> DataFrame:
    """Derivatives of the squared loss."""
    return df.withColumn("g", F.col(margin) - F.col("label")).withColumn("h", F.lit(1.0))


def histogram(rows: DataFrame) -> DataFrame:
    """Gradient sums per (center, node, feature, bin)."""
    long = rows.select("center_id", "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return long.groupBy("center_id", "node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")
    )


def shrunk(g: Column, reg_alpha: float) -> Column:
    """A gradient sum brought ``reg_alpha`` nearer to 0, and not past it: the effect of an L1 penalty on leaves."""
    return F.signum(g) * F.greatest(F.abs(g) - reg_alpha, F.lit(0.0)) if reg_alpha else g


def split_gains(hist: DataFrame, reg_lambda: float = 1.0, min_child: float = 1.0, reg_alpha: float = 0.0) -> DataFrame:
    """Every possible split of every node with its gain and the sums on both sides."""
    node = Window.partitionBy("center_id", "node", "feature")
    upto = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = hist.select(
        "center_id",
        "node",
        "feature",
        "bin",
        F.sum("g").over(upto).alias("gl"),
        F.sum("h").over(upto).alias("hl"),
        F.sum("g").over(node).alias("gt"),
        F.sum("h").over(node).alias("ht"),
    )
    sides = sides.withColumn("gr", F.col("gt") - F.col("gl")).withColumn("hr", F.col("ht") - F.col("hl"))
    score = lambda g, h: shrunk(F.col(g), reg_alpha) * shrunk(F.col(g), reg_alpha) / (F.col(h) + reg_lambda)
    gain = score("gl", "hl") + score("gr", "hr") - score("gt", "ht")
    return sides.where((F.col("hl") >= min_child) & (F.col("hr") >= min_child)).withColumn("gain", gain)


def best_splits(gains: DataFrame, min_gain: float = 0.0) -> DataFrame:
    """The split with the largest gain per node (lowest feature, then bin, on ties)."""
    packed = F.struct("feature", "bin", "gain", "gl", "hl", "gr", "hr")
    order = F.struct(-F.round("gain", 9), F.col("feature"), F.col("bin"))
    return (
        gains.where(F.round("gain", 9) > min_gain)
        .groupBy("center_id", "node")
        .agg(F.min_by(packed, order).alias("_s"))
        .select("center_id", "node", "_s.*")
    )


def level_split(hist: DataFrame, width: int, bins: int, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> DataFrame:
    """One split for all nodes of a level: gains are summed over the center's nodes before the best is taken.
    A node for which the split leaves one side empty is still split."""
    nodes = hist.groupBy("center_id", "node").agg(F.lit(0).alias("_z"))
    grid = nodes.select(
        "center_id",
        "node",
        F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("feature"),
    ).select("center_id", "node", "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    keys = ["center_id", "node", "feature", "bin"]
    full = grid.join(hist, keys, "left").na.fill({"g": 0.0, "h": 0.0})
    gains = split_gains(full, reg_lambda, -1.0, reg_alpha).where(F.col("bin") < bins - 1)
    whole = gains.groupBy("center_id", "feature", "bin").agg(F.sum("gain").alias("gain"))
    order = F.struct(-F.round("gain", 9), F.col("feature"), F.col("bin"))
    best = (
        whole.where(F.round("gain", 9) > 0)
        .groupBy("center_id")
        .agg(F.min_by(F.struct("feature", "bin"), order).alias("_b"))
        .select("center_id", "_b.*")
    )
    return gains.join(best, ["center_id", "feature", "bin"]).select(
        "center_id", "node", "feature", "bin", "gain", "gl", "hl", "gr", "hr"
    )


def with_thresholds(splits: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """The upper edge of the split's bin, the place where the row values are cut."""
    if "cuts" in edges.columns:
        placed = splits.join(edges, "center_id")
        return placed.withColumn("threshold", F.get(F.col("cuts")[F.col("feature")], F.col("bin"))).drop("cuts")
    lo, hi = F.col("lo")[F.col("feature")], F.col("hi")[F.col("feature")]
    placed = splits.join(edges, "center_id")
    return placed.withColumn("threshold", lo + (F.col("bin") + 1) * ((hi - lo) / bins)).drop("lo", "hi")


def split_nodes(splits: DataFrame, rate: float, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> DataFrame:
    """Node rows of the split nodes and of both children as leaves with value -rate * G / (H + lambda), G shrunk by alpha."""

    def leaf(g: str, h: str, child) -> F.Column:
        return F.struct(
            child.alias("node_id"),
            F.lit(-1).alias("feature"),
            F.lit(None).cast("double").alias("threshold"),
            F.lit(-1).alias("left"),
            F.lit(-1).alias("right"),
            (-rate * shrunk(F.col(g), reg_alpha) / (F.col(h) + reg_lambda)).alias("value"),
            F.col(h).alias("sum_hessian"),
        )

    left, right = 2 * F.col("node") + 1, 2 * F.col("node") + 2
    inner = F.struct(
        F.col("node").alias("node_id"),
        F.col("feature"),
        F.col("threshold"),
        left.alias("left"),
        right.alias("right"),
        F.lit(0.0).alias("value"),
        (F.col("hl") + F.col("hr")).alias("sum_hessian"),
    )
    nodes = F.array(inner, leaf("gl", "hl", left), leaf("gr", "hr", right))
    return splits.select("center_id", F.explode(nodes).alias("_n")).select("center_id", "_n.*")


def root_leaves(rows: DataFrame, rate: float, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> DataFrame:
    """Trees of one leaf with value -rate * G / (H + lambda), for centers without a useful split."""
    sums = rows.groupBy("center_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    none = F.lit(-1)
    return sums.select(
        "center_id",
        F.lit(0).alias("node_id"),
        none.alias("feature"),
        F.lit(None).cast("double").alias("threshold"),
        none.alias("left"),
        none.alias("right"),
        (-rate * shrunk(F.col("g"), reg_alpha) / (F.col("h") + reg_lambda)).alias("value"),
        F.col("h").alias("sum_hessian"),
    )


def move_rows(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows to the child nodes; a row whose node was not split keeps it."""
    joined = join_params(rows, splits.select("center_id", "node", "feature", "bin"), ["center_id", "node"], "left")
    right = (F.col("bins")[F.col("feature")] > F.col("bin")).cast("int")
    node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right)
    return joined.withColumn("node", node.cast("int")).drop("feature", "bin")


def grow(
    rows: DataFrame,
    edges: DataFrame,
    width: int,
    depth: int,
    bins: int = 16,
    rate: float = 0.3,
    reg_lambda: float = 1.0,
    min_gain: float = 0.0,
    symmetric: bool = False,
    round_no: int = 1,
    reg_alpha: float = 0.0,
) -> DataFrame:
    """One tree per center from rows (center_id, bins, g, h): one histogram job per level, all centers together.
    Only the splits of a level come back; what is returned is built from them."""
    start = rows.select("center_id", "bins", "g", "h")
    rows = start.withColumn("node", F.lit(0))
    all_splits = None
    for level in range(depth):
        active = rows.where(F.col("node") >= 2**level - 1) if level else rows
        hist = histogram(active)
        found = level_split(hist, width, bins, reg_lambda, reg_alpha) if symmetric else best_splits(split_gains(hist, reg_lambda, 1.0, reg_alpha), min_gain)
        splits = settle(with_thresholds(found, edges, bins))
        all_splits = splits if all_splits is None else all_splits.unionByName(splits)
        if splits.isEmpty():
            break
        if level + 1 < depth:
            rows = move_rows(rows, splits)
    nodes = split_nodes(all_splits, rate, reg_lambda, reg_alpha)
    unsplit = settle(edges.select("center_id").distinct().join(all_splits, "center_id", "left_anti"))
    if not unsplit.isEmpty():
        nodes = nodes.unionByName(root_leaves(join_params(start, unsplit, "center_id"), rate, reg_lambda, reg_alpha))
    if depth > 1:
        # a child that was split itself is an inner node, not the leaf its parent left behind
        names = [c for c in nodes.columns if c not in ("center_id", "node_id")]
        nodes = nodes.groupBy("center_id", "node_id").agg(F.max_by(F.struct(*names), "left").alias("_n")).select("center_id", "node_id", "_n.*")
    return nodes.select(
        F.lit(round_no).alias("round"),
        "center_id",
        F.lit(round_no).alias("tree_id"),
        F.col("node_id").cast("int"),
        F.col("feature").cast("int"),
        "threshold",
        F.col("left").cast("int"),
        F.col("right").cast("int"),
        "value",
        "sum_hessian",
        F.lit(1.0).alias("tree_weight"),
    )


def grow_parallel(rows: DataFrame, edges: DataFrame, width: int, depth: int, parallel: int, key: str, share: float = 1.0, seed: int = 42, rate: float = 0.3, round_no: int = 1, **settings) -> DataFrame:
    """``parallel`` trees per center of one round, from the same gradients, in one histogram job a level for all of them.

    Every tree sees its own ``share`` of the rows by hash; a leaf counts 1 / ``parallel``, so that the trees together step
    as far as one. Tree ids go on from round to round. ``rows`` needs ``key``.
    """
    number = F.explode(F.sequence(F.lit(0), F.lit(parallel - 1)))
    copies = rows.select("center_id", "bins", "g", "h", key, number.alias("_tree"))
    if share < 1.0:
        copies = copies.where(row_hash(key, seed, round_no, F.col("_tree")) < int(share * 4294967296))
    return _grow_side_by_side(copies, edges, width, depth, parallel, rate=rate / parallel, round_no=round_no, **settings)


def grow_classes(rows: DataFrame, edges: DataFrame, width: int, depth: int, classes: int, round_no: int = 1, **settings) -> DataFrame:
    """A tree per center and class from rows with arrays ``gs`` and ``hs``, all classes in one histogram job a level;
    ``class_no`` tells the trees apart."""
    each = rows.select("center_id", "bins", F.posexplode(F.arrays_zip("gs", "hs")).alias("_tree", "_d"))
    grown = _grow_side_by_side(each.select("center_id", "bins", "_tree", F.col("_d.gs").alias("g"), F.col("_d.hs").alias("h")), edges, width, depth, classes, round_no=round_no, **settings)
    return grown.withColumn("class_no", (F.col("tree_id") - (round_no - 1) * classes - 1).cast("int"))


def _grow_side_by_side(copies: DataFrame, edges: DataFrame, width: int, depth: int, many: int, round_no: int, **settings) -> DataFrame:
    """``many`` trees per center, from rows that name their tree in ``_tree``: (center, tree) takes the place of the center."""
    together = (F.col("center_id").cast("bigint") * many + F.col("_tree")).alias("center_id")
    numbers = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("_tree"))
    own_edges = settle(numbers.select(together, *[c for c in edges.columns if c != "center_id"]))
    grown = grow(copies.select(together, "bins", "g", "h"), own_edges, width, depth, round_no=round_no, **settings)
    tree = F.pmod(F.col("center_id"), F.lit(many))
    ids = ((round_no - 1) * many + tree + 1).cast("int")
    center = ((F.col("center_id") - tree) / many).cast("int")
    return grown.withColumn("tree_id", ids).withColumn("center_id", center)


def softmax_gradients(df: DataFrame, classes: int, margins: str = "margins") -> DataFrame:
    """Derivatives of the softmax loss for every class, in arrays ``gs`` and ``hs``; the label is the class's number."""
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(powers, lambda x: x / total)
    out = df.withColumn("_p", shares)
    hit = lambda p, k: p - F.when(F.col("label") == k, 1.0).otherwise(0.0)
    return out.withColumn("gs", F.transform("_p", hit)).withColumn("hs", F.transform("_p", lambda p: p * (1 - p))).drop("_p")


def add_margins(rows: DataFrame, trees: DataFrame, classes: int, out: str = "margins") -> DataFrame:
    """``out``, an array with a margin for each class, plus the weighted leaf values of each class's trees (``class_no``)."""
    if out not in rows.columns:
        rows = rows.withColumn(out, F.array_repeat(F.lit(0.0), classes))
    for pdf in _tree_chunks(trees):
        heads = pdf.sort_values(["round", "center_id", "tree_id", "node_id"]).drop_duplicates(["round", "center_id", "tree_id"])
        shared = rows.sparkSession.sparkContext.broadcast((_flatten(pdf), np.eye(classes)[heads["class_no"].to_numpy(int)]))
        schema = T.StructType(list(rows.schema.fields) + [T.StructField("_add", T.ArrayType(T.DoubleType()))])

        def walk(batches, shared=shared):
            flat, owner = shared.value
            for batch in batches:
                if len(batch):
                    total = (_walk(_feature_matrix(batch), flat) * flat[7]) @ owner
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * classes, pa.int32()), pa.array(total.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_add"])

        rows = rows.mapInArrow(walk, schema).withColumn(out, F.zip_with(out, "_add", lambda a, b: a + b)).drop("_add")
    return rows


def symmetric_tables(trees: DataFrame) -> DataFrame:
    """Oblivious trees as they are scored: (round, center_id, tree_id, tree_weight, rules, leaves): a feature and a threshold
    for each level, and leaf values by the number that the levels' answers spell in binary.

    A leaf above the last level, left by a node without rows, stands for all numbers below it."""
    keys = ["round", "center_id", "tree_id"]
    level = F.floor(F.log2(F.col("node_id") + 1.0 + 1e-9)).cast("int")
    leveled = trees.withColumn("_l", level)
    rules = leveled.where("feature >= 0").groupBy(*keys, "_l").agg(F.first("feature").alias("feature"), F.first("threshold").alias("threshold"))
    rules = rules.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_l", "feature", "threshold"))).alias("rules"))
    depths = leveled.groupBy(*keys).agg(F.max("_l").alias("_d"), F.max(F.coalesce("tree_weight", F.lit(1.0))).alias("tree_weight"))
    leaves = leveled.where("feature < 0").join(depths.drop("tree_weight"), keys)
    first = (F.col("node_id") + 1 - F.expr("shiftleft(1, _l)")) * F.expr("shiftleft(1, _d - _l)")
    each = leaves.select(*keys, F.explode(F.sequence(first, first + F.expr("shiftleft(1, _d - _l)") - 1)).alias("place"), "value")
    values = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda v: v["value"]).alias("leaves"))
    none = F.array().cast("array<struct<_l:int,feature:int,threshold:double>>")
    return depths.drop("_d").join(values, keys).join(rules, keys, "left").select(*keys, "tree_weight", F.coalesce("rules", none).alias("rules"), "leaves")


def score_symmetric(rows: DataFrame, trees: DataFrame, out: str = "margin", own_center: bool = False) -> DataFrame:
    """``out`` plus the weighted leaf values of oblivious trees, found by index: a bit per level, no walk, all in generated code.

    With ``own_center`` a row is joined to the trees of its center alone, so the work doesn't grow with the number of centers."""
    tables = settle(symmetric_tables(trees))
    if out not in rows.columns:
        rows = rows.withColumn(out, F.lit(0.0))
    entry = F.struct("round", "center_id", "tree_id", "tree_weight", "rules", "leaves")
    keyed = tables if own_center else tables.withColumn("_of", F.lit(0))
    on = "center_id" if own_center else "_of"
    packed = keyed.groupBy(on).agg(F.sort_array(F.collect_list(entry.alias("_e"))).alias("_trees"))
    joined = join_params(rows if own_center else rows.withColumn("_of", F.lit(0)), packed, on, "left")
    place = lambda t: F.aggregate(t["rules"], F.lit(0), lambda i, r: 2 * i + F.when(F.get(F.col("features"), r["feature"]) < r["threshold"], 0).otherwise(1))
    total = F.aggregate(F.coalesce("_trees", F.array().cast(packed.schema["_trees"].dataType)), F.lit(0.0), lambda s, t: s + t["tree_weight"] * F.get(t["leaves"], place(t)))
    return joined.withColumn(out, F.col(out) + total).drop("_trees", "_of")


def _flatten(pdf) -> tuple:
    """Tree rows as flat arrays: child links point into the same arrays, leaves point to themselves."""
    order = ["round", "center_id", "tree_id", "node_id"]
    pdf = pdf.sort_values(order).reset_index(drop=True)
    key = pdf[["round", "center_id", "tree_id"]].apply(tuple, axis=1)
    where = {(k, n): i for i, (k, n) in enumerate(zip(key, pdf["node_id"]))}
    here = np.arange(len(pdf))
    leaf = (pdf["left"] < 0).to_numpy()
    left = np.array([i if l else where[(k, n)] for i, l, k, n in zip(here, leaf, key, pdf["left"])], dtype=np.int64)
    right = np.array([i if l else where[(k, n)] for i, l, k, n in zip(here, leaf, key, pdf["right"])], dtype=np.int64)
    heads = np.flatnonzero(~key.duplicated().to_numpy())
    depth = 0
    level = heads
    while len(level) and not leaf[level].all():
        level = np.unique(np.concatenate([left[level], right[level]]))
        depth += 1
        if depth > 64:
            raise ValueError("tree links do not end")
    return (
        np.where(leaf, 0, pdf["feature"]).astype(np.int64),
        np.where(leaf, np.inf, pdf["threshold"].astype(float)),
        left,
        right,
        pdf["value"].to_numpy(float),
        heads,
        pdf["center_id"].to_numpy()[heads],
        pdf["tree_weight"].fillna(1.0).to_numpy(float)[heads],
        depth,
    )


def _walk(features: np.ndarray, flat: tuple) -> np.ndarray:
    """Leaf values of all trees for all rows of a batch: (rows, trees)."""
    feature, threshold, left, right, value, heads, _, _, depth = flat
    at = np.broadcast_to(heads, (len(features), len(heads))).copy()
    row = np.arange(len(features))[:, None]
    for _ in range(depth):
        goes_left = features[row, feature[at]] < threshold[at]
        at = np.where(goes_left, left[at], right[at])
    return value[at]


def _feature_matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("features"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float, copy=False)


def _tree_chunks(trees: DataFrame):
    """The trees in parts of at most about half a million nodes, so what is broadcast has a fixed bound."""
    local = trees.limit(NODES_PER_PASS + 1).toArrow()
    if local.num_rows <= NODES_PER_PASS:
        if local.num_rows:
            yield local.to_pandas()
        return
    keys = ["round", "center_id", "tree_id"]
    sizes = trees.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(sizes, keys, upto=F.col("n"))
    numbered = settle(placed.select(*keys, "n", F.floor((F.col("upto") - 1) / NODES_PER_PASS).cast("int").alias("part")))
    for part in range(numbered.agg(F.max("part")).first()[0] + 1):
        yield trees.join(numbered.where(F.col("part") == part).drop("n", "part"), keys, "left_semi").toPandas()


def encode_trees(rows: DataFrame, trees: DataFrame, out: str = "tree_out") -> DataFrame:
    """The leaf value of every single tree as an array, trees in (round, center, tree) order."""
    rows = rows.withColumn(out, F.array().cast("array<double>"))
    for pdf in _tree_chunks(trees):
        shared = rows.sparkSession.sparkContext.broadcast(_flatten(pdf))
        schema = T.StructType(list(rows.schema.fields) + [T.StructField("_part", T.ArrayType(T.DoubleType()))])

        def walk(batches, shared=shared):
            for batch in batches:
                if len(batch):
                    leaves = _walk(_feature_matrix(batch), shared.value)
                    offsets = pa.array(np.arange(len(leaves) + 1) * leaves.shape[1], pa.int32())
                    column = pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_part"])

        rows = rows.mapInArrow(walk, schema).withColumn(out, F.concat(out, "_part")).drop("_part")
    return rows


def add_margin(rows: DataFrame, trees: DataFrame, out: str = "margin", own_center: bool = False) -> DataFrame:
    """``out`` plus the weighted sum of the trees' leaf values. With ``own_center`` a row meets only the
    trees of its own center."""
    if out not in rows.columns:
        rows = rows.withColumn(out, F.lit(0.0))
    for pdf in _tree_chunks(trees):
        flat = {c: _flatten(part) for c, part in pdf.groupby("center_id")} if own_center else _flatten(pdf)
        shared = rows.sparkSession.sparkContext.broadcast(flat)
        schema = T.StructType(list(rows.schema.fields) + [T.StructField("_add", T.DoubleType())])

        def walk(batches, shared=shared):
            for batch in batches:
                if not len(batch):
                    continue
                features = _feature_matrix(batch)
                if own_center:
                    center = batch.column(batch.schema.get_field_index("center_id")).to_numpy(zero_copy_only=False)
                    total = _own_sums(features, center, shared.value)
                else:
                    total = (_walk(features, shared.value) * shared.value[7]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], [*batch.schema.names, "_add"])

        rows = rows.mapInArrow(walk, schema).withColumn(out, F.col(out) + F.col("_add")).drop("_add")
    return rows


def _own_sums(features: np.ndarray, centers: np.ndarray, forests: dict) -> np.ndarray:
    """Weighted leaf sums of each row over the trees of its own center alone; 0 for centers without trees."""
    total = np.zeros(len(features))
    order = np.argsort(centers, kind="stable")
    found, first = np.unique(centers[order], return_index=True)
    for center, rows in zip(found, np.split(order, first[1:])):
        flat = forests.get(center)
        if flat is not None:
            total[rows] = (_walk(features[rows], flat) * flat[7]).sum(axis=1)
    return total


def score_boosted(rows: DataFrame, trees: DataFrame, base: float = 0.0, own_center: bool = False) -> DataFrame:
    """Probability from the base margin and the weighted leaf values."""
    scored = add_margin(rows.withColumn("margin", F.lit(float(base))), trees, own_center=own_center)
    return scored.withColumn("score", sigmoid(F.col("margin"))).drop("margin")


def score_forest(rows: DataFrame, trees: DataFrame, own_center: bool = False) -> DataFrame:
    """Mean over the trees of the class-1 share in the row's leaf."""
    n = trees.select("round", "center_id", "tree_id").distinct()
    if own_center:
        encoded = add_margin(rows.withColumn("score", F.lit(0.0)), trees, "score", own_center=True)
        counts = n.groupBy("center_id").agg(F.count(F.lit(1)).alias("_t"))
        return join_params(encoded, counts, "center_id", "left").withColumn("score", F.col("score") / F.coalesce("_t", F.lit(1))).drop("_t")
    total = max(n.count(), 1)
    return add_margin(rows.withColumn("score", F.lit(0.0)), trees, "score").withColumn("score", F.col("score") / F.lit(float(total)))


def row_subsample(rows: DataFrame, key: str, share: float, *salt) -> DataFrame:
    """A repeatable share of the rows for one tree."""
    return rows.where(row_hash(key, *salt) < int(share * 4294967296))
