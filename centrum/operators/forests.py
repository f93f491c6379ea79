"""Random forests of all centers together.

Every tree of every center weighs the rows by Poisson counts that follow from the row's hash, so a bag is never stored.
Rows of one center, label and bins (a cell) go the same way in every tree: they are stored side by side, and a task adds up
their counts in each bag before anything else. Centers and nodes with few cells are sent as a whole to one task, which grows
what is below; larger ones are split by one histogram job a level, for all trees and centers at once. The number of jobs
depends on the largest center and on the depth, never on the number of centers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from centrum.functions.columns import row_hash
from centrum.operators.binning import sketch_edges, with_cut_bins
from centrum.operators.ordering import hash_position, join_params, settle
from centrum.operators.trees import TREES
from centrum.session import scratch_path

#: A center with at most so many cells, or a node with so many rows, is grown in one task, if they take at most so many bytes.
SMALL, SMALL_BYTES = 2_000_000, 20 << 20
#: Counts of cells by trees that a task holds before it sends them on, and counts of a level that it adds up.
HELD, LEVEL_CELLS = 4_000_000, 4_000_000
#: Nodes that are split at once and broadcast; more trees are grown in further passes.
NODES_PER_PASS = 400_000
BINS = 32
#: The multipliers of a 32-bit finaliser.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
_WORD = 1 << 32

NODES = (
    "center_id int, tree_id int, node_id int, feature int, threshold double, left int, right int, value double, n0 long, n1 long, gain double"
)
_SPLIT = pa.schema([("center_id", pa.int32()), ("tree_id", pa.int32()), ("node_id", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
                    ("n0", pa.int64()), ("n1", pa.int64()), ("left0", pa.int64()), ("left1", pa.int64())])


def mix(x, salt):
    """A 32-bit number from two: xor with a multiple of the salt, then two rounds of multiply and shift."""
    x = np.asarray(x).astype(np.uint32) ^ (np.asarray(salt, np.uint64) * np.uint64(MIX[0]) % np.uint64(_WORD)).astype(np.uint32)
    with np.errstate(over="ignore"):  # products are cut to 32 bits
        x = x * np.uint32(MIX[1])
        x = x ^ (x >> np.uint32(13))
        x = x * np.uint32(MIX[2])
    return x ^ (x >> np.uint32(16))


def poisson_steps(rate: float) -> np.ndarray:
    """32-bit limits: the number of them up to a hash is a Poisson count with this mean."""
    steps, share, total = [], math.exp(-rate), 0.0
    for k in range(1, 40):
        total += share
        if total >= 1 - 1e-9:
            break
        steps.append(math.floor(total * _WORD))
        share *= rate / k
    return np.array(steps, np.uint64)


def bag_limits(rates: np.ndarray) -> list:
    """What a row's number must exceed to lie in a bag once more, by the counts before: a number for all rows, or one each."""
    known, at = np.unique(rates, return_inverse=True)
    steps = [poisson_steps(float(rate)) for rate in known]
    limits = np.full((max(map(len, steps), default=0), len(known)), _WORD - 1, np.uint32)
    for i, own in enumerate(steps):
        limits[: len(own), i] = own - np.uint64(1)
    return [row[0] if len(known) == 1 else row[at] for row in limits]


def bag_counts(hashes: np.ndarray, tree: int, limits: list) -> np.ndarray:
    """How often each row lies in a tree's bag."""
    drawn = mix(hashes, tree + 1)
    out = np.zeros(len(hashes), np.uint8)
    for limit in limits:
        more = drawn > limit
        if not more.any():
            break
        out += more
    return out


def node_features(center, tree, node, width: int, per_node: int, seed: int) -> np.ndarray:
    """The features that a node may be split by, in order: those with the lowest hashes."""
    base = mix(mix(mix(np.asarray(center, np.int64) & 0xFFFFFFFF, seed & 0xFFFFFFFF), np.asarray(tree) + 1), np.asarray(node) + 1)
    drawn = np.stack([mix(base, f + 1) for f in range(width)], axis=-1)
    return np.sort(np.argsort(drawn, axis=-1, kind="stable")[..., :per_node], axis=-1)


def best_splits(cells: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The split with the largest drop of the weighted Gini impurity for each node.

    ``cells`` counts (node, slot, bin, class), ``weights`` gives each node's class weights. Both sides must hold rows.
    Ties go to the first slot, then the lowest bin. Returns slot, bin, gain (0: no split) and the counts that go left.
    """
    left = np.cumsum(cells, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def purity(n: np.ndarray) -> np.ndarray:
        w = n * weights[:, None, None, :]
        mass = w.sum(axis=3)
        return np.divide((w * w).sum(axis=3), mass, out=np.zeros_like(mass), where=mass > 0)

    gain = purity(left) + purity(right) - purity(whole)
    gain = np.where((left.sum(axis=3) > 0) & (right.sum(axis=3) > 0), np.round(gain, 9), 0.0)
    flat = gain.reshape(len(cells), -1)
    best = flat.argmax(axis=1)
    slot, at = np.divmod(best, cells.shape[2])
    node = np.arange(len(cells))
    return slot, at, flat[node, best], left[node, slot, at]


def _histogram(bins: np.ndarray, label: np.ndarray, bag: np.ndarray, node: np.ndarray, features: np.ndarray, n_bins: int) -> np.ndarray:
    """Counts (node, slot, bin, class) of rows in nodes, each looked at by its node's features."""
    nodes, slots = features.shape
    row = np.arange(len(node))
    out = np.zeros(nodes * slots * n_bins * 2, np.int64)
    for j in range(slots):
        cell = ((node * slots + j) * n_bins + bins[row, features[node, j]]) * 2 + label
        out += np.bincount(cell, bag, len(out)).astype(np.int64)
    return out.reshape(nodes, slots, n_bins, 2)


def subtree(bins, label, bag, weights, center: int, tree: int, root: int, depth: int, per_node: int, seed: int, n_bins: int) -> dict[str, list]:
    """All nodes at and below ``root`` from the rows in it; nodes of the last level, pure ones and those without a gain are leaves."""
    out: dict[str, list] = {k: [] for k in ("node_id", "feature", "bin", "gain", "n0", "n1")}
    active, node = np.array([root], np.int64), np.zeros(len(label), np.int64)
    level = (root + 1).bit_length() - 1
    while len(active):
        features = node_features(center, tree, active, bins.shape[1], per_node, seed)
        if level < depth:
            cells = _histogram(bins, label, bag, node, features, n_bins)
            slot, at, gain, _ = best_splits(cells, np.broadcast_to(weights, (len(active), 2)))
            counts = cells[:, 0].sum(axis=1)
        else:
            slot, at, gain = np.zeros(len(active), int), np.zeros(len(active), int), np.zeros(len(active))
            counts = np.bincount(node * 2 + label, bag, 2 * len(active)).astype(np.int64).reshape(-1, 2)
        split = gain > 0
        feature = np.where(split, features[np.arange(len(active)), slot], -1)
        for name, values in (("node_id", active), ("feature", feature), ("bin", at), ("gain", gain), ("n0", counts[:, 0]), ("n1", counts[:, 1])):
            out[name] += values.tolist()
        stay = split[node]
        bins, label, bag, node = bins[stay], label[stay], bag[stay], node[stay]
        right = bins[np.arange(len(node)), feature[node]] > at[node]
        place = np.cumsum(split) - 1
        active = np.stack([2 * active[split] + 1, 2 * active[split] + 2], axis=1).ravel()
        node, level = 2 * place[node] + right, level + 1
    return out


class _Walk:
    """The splits made so far, as sorted arrays, and where rows of a tree have come to."""

    def __init__(self, splits: dict[tuple[int, int, int], tuple[int, int]], frontier: list[tuple[int, int, int]]):
        self.by_tree: dict[int, dict] = {}
        for (center, tree, node), (feature, at) in splits.items():
            self.by_tree.setdefault(tree, {})[center << 32 | node] = (feature, at)
        for tree, own in self.by_tree.items():
            keys = np.array(sorted(own), np.int64)
            self.by_tree[tree] = (keys, np.array([own[k] for k in keys.tolist()], np.int64))
        self.ends: dict[int, np.ndarray] = {}
        for center, tree, node in frontier:
            self.ends.setdefault(tree, []).append(center << 32 | node)
        self.ends = {t: np.array(sorted(k), np.int64) for t, k in self.ends.items()}

    def place(self, tree: int, center: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of each row, and the number of that node among the tree's frontier or -1."""
        key = center.astype(np.int64) << 32
        if tree in self.by_tree:
            keys, rule = self.by_tree[tree]
            row = np.arange(len(key))
            while len(row):
                at = np.minimum(np.searchsorted(keys, key[row]), len(keys) - 1)
                inner = keys[at] == key[row]
                row, at = row[inner], at[inner]
                node = key[row] & 0xFFFFFFFF
                right = bins[row, rule[at, 0]] > rule[at, 1]
                key[row] = (key[row] - node) + 2 * node + 1 + right
        if tree not in self.ends:
            return key & 0xFFFFFFFF, np.full(len(key), -1)
        ends = self.ends[tree]
        at = np.minimum(np.searchsorted(ends, key), len(ends) - 1)
        return key & 0xFFFFFFFF, np.where(ends[at] == key, at, -1)


def _cells(batch: pa.RecordBatch, width: int, block) -> tuple[np.ndarray, ...]:
    """Center, label and bins of each run of equal rows, and its counts in the bags of each tree: (cell, tree)."""
    col = lambda n: batch.column(batch.schema.get_field_index(n))
    center, label = col("center_id").to_numpy().astype(np.int64), col("label").to_numpy().astype(np.int64)
    h, bins = col("h").to_numpy().astype(np.uint32), col("bins").flatten().to_numpy().reshape(-1, width).astype(np.uint8)
    new = (center[1:] != center[:-1]) | (label[1:] != label[:-1]) | (bins[1:] != bins[:-1]).any(axis=1)
    heads = np.flatnonzero(np.concatenate([[True], new]))
    limits = bag_limits(col("rate").to_numpy())
    counts = np.empty((len(block), len(heads)), np.int32)
    for i, tree in enumerate(block):
        counts[i] = np.add.reduceat(bag_counts(h, tree, limits).astype(np.int32), heads)
    return center[heads], label[heads], bins[heads], counts


def _held_cells(batches: Iterator[pa.RecordBatch], width: int, block) -> Iterator[tuple[np.ndarray, ...]]:
    """The cells of several batches at once, up to ``HELD`` counts."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_cells(batch, width, block))
        size += held[-1][3].size
        if size >= HELD:
            yield tuple(np.concatenate(v, axis=k) for v, k in zip(zip(*held), (0, 0, 0, 1)))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(v, axis=k) for v, k in zip(zip(*held), (0, 0, 0, 1)))


def prepared(df: DataFrame, key: str, width: int, bins: int, balance: bool, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(binned rows with hash and bag rate, written once, those of a cell side by side; class counts and weights per center; cut points)."""
    edges = sketch_edges(df, width, bins)
    n = lambda c: F.count(F.when(F.col("label") == c, 1))
    stats = df.groupBy("center_id").agg(n(0).alias("n0"), n(1).alias("n1"))
    least = F.least("n0", "n1")
    rate = lambda c: F.when(F.lit(balance) & (F.col(c) > 0), least / F.col(c)).otherwise(1.0)
    share = lambda c: F.when(F.lit(balance) | (F.col(c) == 0), 1.0).otherwise((F.col("n0") + F.col("n1")) / (2 * F.col(c)))
    stats = settle(stats.select("center_id", "n0", "n1", rate("n0").alias("rate0"), rate("n1").alias("rate1"), share("n0").alias("w0"), share("n1").alias("w1")))
    rows = with_cut_bins(df.select("center_id", "label", "features", row_hash(key, seed).alias("h")), edges, width)
    rows = join_params(rows, stats.select("center_id", "rate0", "rate1"), "center_id")
    path = scratch_path(df.sparkSession, "forest-rows")
    own_rate = F.when(F.col("label") == 1, F.col("rate1")).otherwise(F.col("rate0"))
    rows = rows.where("label is not null").select(F.col("center_id").cast("int"), "h", F.col("label").cast("int"), own_rate.alias("rate"), "bins")
    # rebalanced and not repartitioned: a cell may hold any share of the rows, and Spark then splits its partition
    rows.withColumn("cell", F.xxhash64("center_id", "label", "bins")).hint("rebalance", "cell").sortWithinPartitions("cell").drop("cell").write.parquet(path)
    return df.sparkSession.read.parquet(path), stats, edges


def forest_nodes(
    df: DataFrame, key: str, width: int, trees: int = 100, depth: int = 10, balance: bool = False, seed: int = 42, bins: int = BINS,
    per_node: int | None = None, small: int = SMALL, nodes_per_pass: int = NODES_PER_PASS,
) -> DataFrame:
    """The nodes of ``trees`` trees for every center: NODES, with the class counts of each node's bag and its gain.

    Every tree weighs a row by a Poisson count of mean 1, the size of a draw with replacement; with ``balance`` the larger
    class has a smaller mean, so that both classes weigh the same in each bag. Without it classes are weighted in the impurity. A
    node may be split by ``per_node`` features (the whole root of ``width``), drawn by its hash, at ``bins`` cut points from sketches.
    Rows without a label are left out; null features lie in the lowest bin; a tree whose bag is empty has no nodes. The result doesn't depend on partitions or on ``small``.
    """
    if depth < 1 or not 2 <= bins <= 256:
        raise ValueError("depth must be 1 or more, bins between 2 and 256")
    per_node = per_node or max(1, math.isqrt(width))
    spark = df.sparkSession
    rows, stats, edges = prepared(df, key, width, bins, balance, seed)
    small = min(small, SMALL_BYTES // (width + 5))
    drawn = F.col("n0") * F.col("rate0") + F.col("n1") * F.col("rate1")
    large = {r["center_id"]: r for r in stats.where(drawn > small).withColumn("drawn", drawn).toLocalIterator()}
    if large:  # counted only where rows don't settle it, and nearly: a limit on a task's memory may be passed by some per cent
        kinds = rows.groupBy("center_id").agg(F.approx_count_distinct(F.xxhash64("label", "bins")).alias("cells"))
        many = {r["center_id"] for r in kinds.where(F.col("cells") > small).toLocalIterator()}
        large = {c: r for c, r in large.items() if c in many}
    weights = {c: (r["w0"], r["w1"]) for c, r in large.items()}
    expected = sum(4 * int(r["drawn"] // small) for r in large.values())
    at_once = max(1, min(trees, nodes_per_pass // max(int(expected), 1)))
    parts = []
    for first in range(0, trees, at_once):
        block = range(first, min(first + at_once, trees))
        splits, rest = _large_nodes(rows, weights, block, width, depth, per_node, seed, bins, small)
        parts.append(_small_nodes(rows, stats, weights, splits, rest, block, width, depth, per_node, seed, bins))
        if splits:
            parts.append(spark.createDataFrame(pa.Table.from_pylist(list(splits.values()), schema=_SPLIT)).drop("left0", "left1"))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    w = stats.select("center_id", "w0", "w1")
    full = join_params(join_params(nodes, edges, "center_id"), w, "center_id")
    inner = F.col("feature") >= 0
    one, mass = F.col("n1") * F.col("w1"), F.col("n0") * F.col("w0") + F.col("n1") * F.col("w1")
    child = lambda k: F.when(inner, 2 * F.col("node_id") + k).otherwise(-1).cast("int")
    return full.select(
        F.col("center_id").cast("int"), "tree_id", "node_id", "feature", F.when(inner, F.get(F.col("cuts")[F.col("feature")], F.col("bin"))).alias("threshold"),
        child(1).alias("left"), child(2).alias("right"), F.when(inner, 0.0).otherwise(F.try_divide(one, mass)).alias("value"), "n0", "n1", "gain",
    )


def _large_nodes(rows, weights, block, width, depth, per_node, seed, bins, small) -> tuple[dict, list]:
    """Splits of all nodes with more than ``small`` rows, level by level, and the smaller nodes left below them.

    What comes back from a level is one row for each node that was split.
    """
    frontier = [(c, t, 0) for c in weights for t in block]
    splits: dict[tuple, dict] = {}
    rest: list[tuple[int, int, int]] = []
    spark = rows.sparkSession
    for level in range(depth):
        if not frontier:
            break
        shared = spark.sparkContext.broadcast((_Walk({k: (v["feature"], v["bin"]) for k, v in splits.items() if v["feature"] >= 0}, frontier), weights))

        found = _level_splits(rows, shared, width, per_node, seed, bins).toArrow()
        frontier = []
        for row in found.to_pylist():
            place = row["center_id"], row["tree_id"], row["node_id"]
            splits[place] = row
            if row["feature"] >= 0:
                for child, n0, n1 in ((1, row["left0"], row["left1"]), (2, row["n0"] - row["left0"], row["n1"] - row["left1"])):
                    below = (*place[:2], 2 * row["node_id"] + child)
                    if level + 1 == depth or not n0 or not n1:  # a leaf, known from its parent's counts
                        splits[below] = dict(zip(_SPLIT.names, (*below, -1, 0, 0.0, n0, n1, 0, 0)))
                    else:
                        (frontier if n0 + n1 > small else rest).append(below)
    return splits, rest


def _level_splits(rows: DataFrame, shared, width: int, per_node: int, seed: int, bins: int) -> DataFrame:
    """The best split of every node that a broadcast walk ends in: class counts per cell in tasks, summed, one row a node."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, _ = shared.value
        block = list(walk.ends)
        add_up = sum(map(len, walk.ends.values())) * per_node * bins * 2 <= LEVEL_CELLS
        sums: dict[int, np.ndarray] = {}

        def out(tree: int, cells: np.ndarray) -> pa.RecordBatch:
            ends = walk.ends[tree]
            flat = cells.reshape(len(ends), -1)
            node, cell = np.nonzero(flat)
            columns = [(ends >> 32)[node].astype(np.int32), np.full(len(node), tree, np.int32), (ends & 0xFFFFFFFF)[node].astype(np.int32), cell.astype(np.int32), flat[node, cell]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["center_id", "tree_id", "node_id", "cell", "n"])

        for center, label, b, counts in _held_cells(batches, width, block):
            for tree, bag in zip(block, counts):
                at, ends = walk.place(tree, center, b)[1], walk.ends[tree]
                on = np.flatnonzero((bag > 0) & (at >= 0))
                if not len(on):
                    continue
                cells = _histogram(b[on], label[on], bag[on], at[on], node_features(ends >> 32, tree, ends & 0xFFFFFFFF, width, per_node, seed), bins)
                if add_up:
                    sums[tree] = sums[tree] + cells if tree in sums else cells
                else:
                    yield out(tree, cells)
        for tree, cells in sums.items():
            yield out(tree, cells)

    def choose(table: pa.Table) -> pa.Table:
        center, tree, node = (table.column(c)[0].as_py() for c in ("center_id", "tree_id", "node_id"))
        cells = np.zeros(per_node * bins * 2, np.int64)
        cells[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        cells = cells.reshape(1, per_node, bins, 2)
        slot, at, gain, left = best_splits(cells, np.array([shared.value[1][center]]))
        n0, n1 = cells[0, 0].sum(axis=0).tolist()
        feature = int(node_features(center, tree, node, width, per_node, seed)[slot[0]]) if gain[0] > 0 else -1
        row = [center, tree, node, feature, int(at[0]), float(gain[0]), n0, n1, *left[0].tolist()]
        return pa.Table.from_pylist([dict(zip(_SPLIT.names, row))], schema=_SPLIT)

    cells = rows.mapInArrow(count, "center_id int, tree_id int, node_id int, cell int, n long")
    summed = cells.groupBy("center_id", "tree_id", "node_id", "cell").agg(F.sum("n").alias("n"))
    kinds = "center_id int, tree_id int, node_id int, feature int, bin int, gain double, n0 long, n1 long, left0 long, left1 long"
    return summed.groupBy("center_id", "tree_id", "node_id").applyInArrow(choose, kinds)


def _small_nodes(rows, stats, weights, splits, rest, block, width, depth, per_node, seed, bins) -> DataFrame:
    """Everything at and below the nodes with few rows, and the whole trees of small centers. Each node's cells go to one task, as bytes."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((_Walk({k: (v["feature"], v["bin"]) for k, v in splits.items() if v["feature"] >= 0}, rest), np.array(sorted(weights), np.int64)))
    schema = pa.schema([("center_id", pa.int32()), ("tree_id", pa.int32()), ("node_id", pa.int32()), ("cells", pa.binary()), ("bag", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, large = shared.value
        for center, label, b, counts in _held_cells(batches, width, block):
            in_large = np.isin(center, large)
            cells = np.concatenate([b, label[:, None].astype(np.uint8)], axis=1)
            by_center = np.argsort(center, kind="stable")
            found = {n: [] for n in schema.names}
            for tree, bag in zip(block, counts):
                if len(large):
                    node, at = walk.place(tree, center, b)
                    key = center << 32 | node
                    order = np.argsort(key, kind="stable")
                    on = order[((bag > 0) & ((at >= 0) | ~in_large))[order]]
                else:
                    key, on = center << 32, by_center[bag[by_center] > 0]
                if not len(on):
                    continue
                own, data, bag = key[on], cells[on], bag[on]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(on)]):
                    n = bag[a:z].astype(np.uint8 if bag[a:z].max() < 256 else "<u4")
                    for name, value in zip(schema.names, (int(own[a] >> 32), tree, int(own[a] & 0xFFFFFFFF), data[a:z].tobytes(), n.tobytes())):
                        found[name].append(value)
                if len(found["cells"]) > 2000:
                    yield pa.RecordBatch.from_pydict(found, schema=schema)
                    found = {n: [] for n in schema.names}
            if found["cells"]:
                yield pa.RecordBatch.from_pydict(found, schema=schema)

    def grow(table: pa.Table) -> pa.Table:
        center, tree, root, w0, w1 = (table.column(c)[0].as_py() for c in ("center_id", "tree_id", "node_id", "w0", "w1"))
        parts = list(zip(*(table.column(c).to_pylist() for c in ("cells", "bag"))))
        data = np.frombuffer(b"".join(c for c, _ in parts), np.uint8).reshape(-1, width + 1)
        bag = np.concatenate([np.frombuffer(n, np.uint8 if len(n) * (width + 1) == len(c) else "<u4") for c, n in parts]).astype(np.int64)
        made = subtree(data[:, :width], data[:, width].astype(np.int64), bag, np.array([w0, w1]), center, tree, root, depth, per_node, seed, bins)
        made |= {"center_id": [center] * len(made["node_id"]), "tree_id": [tree] * len(made["node_id"])}
        return pa.table({n: pa.array(made[n], t) for n, t in zip(wanted.names, wanted.types)})

    wanted = pa.schema([_SPLIT.field(i) for i in range(8)])
    members = rows.mapInArrow(gather, "center_id int, tree_id int, node_id int, cells binary, bag binary")
    members = join_params(members, stats.select("center_id", "w0", "w1"), "center_id")
    grown = members.groupBy("center_id", "tree_id", "node_id").applyInArrow(grow, "center_id int, tree_id int, node_id int, feature int, bin int, gain double, n0 long, n1 long")
    path = scratch_path(spark, "forest-nodes")
    grown.write.parquet(path)
    return spark.read.parquet(path)


def balanced_draw(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Equal class sizes per center: each class keeps as many rows, first in hash order, as the smallest class has."""
    ranked = hash_position(df, ["center_id", "label"], key, seed)
    least = df.groupBy("center_id", "label").count().groupBy("center_id").agg(F.min("count").alias("_least"))
    return join_params(ranked, least, "center_id").where(F.col("pos") <= F.col("_least")).drop("pos", "n_group", "_least")


def forest_round(df: DataFrame, key: str, trees: int = 100, depth: int = 10, balance: bool = False, seed: int = 42, round_no: int = 1, width: int | None = None, **settings) -> DataFrame:
    """A forest for every center as rows of TREES; the value of a leaf is its weighted share of class 1."""
    if width is None:
        first = df.select(F.size("features").alias("n")).first()
        width = first["n"] if first else 1
    nodes = forest_nodes(df, key, width, trees, depth, balance, seed, **settings)
    none, one = F.lit(None).cast("double"), F.lit(1.0)
    out = nodes.select(F.lit(round_no).cast("int").alias("round"), *[c for c in nodes.columns if c not in ("n0", "n1", "gain")], none.alias("sum_hessian"), one.alias("tree_weight"))
    return out.to(df.sparkSession.createDataFrame([], TREES).schema)


def importances(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(center_id, feature, score): each tree's gains by feature as shares of its sum, averaged over the center's trees."""
    trees = nodes.select("center_id", "tree_id").distinct().groupBy("center_id").agg(F.count("*").alias("trees"))
    sums = nodes.where("feature >= 0").groupBy("center_id", "tree_id", "feature").agg(F.sum("gain").alias("gain"))
    share = sums.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("center_id", "tree_id")))
    every = trees.select("center_id", "trees", F.posexplode(F.array(*map(F.lit, names))).alias("feature", "name"))
    found = share.groupBy("center_id", "feature").agg(F.sum("share").alias("share"))
    whole = F.sum(F.coalesce("share", F.lit(0.0))).over(Window.partitionBy("center_id"))
    joined = every.join(found, ["center_id", "feature"], "left")
    score = F.when(whole > 0, F.coalesce("share", F.lit(0.0)) / whole).otherwise(0.0)
    return joined.select("center_id", F.col("name").alias("feature"), score.alias("score"))
