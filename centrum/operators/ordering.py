"""Exact positions, medians and look-ups that never gather a whole group in one task.

A group may hold a third of all rows, so nothing here sorts a group in one task: slices of a shuffled order are
cut where counts per hash bucket say, positions are taken inside buckets of a group and shifted by the bucket's
offset, medians only sort the few values around the middle, and small tables are broadcast only after their row
count was checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from centrum.functions.columns import HASH_RANGE, row_hash, whole_div
from centrum.session import cut_lineage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def rank_buckets(spark: SparkSession) -> int:
    """Buckets per group: at least 1,024 and four times the shuffle partitions, so one hot group still fills
    every partition. The position itself does not depend on this number."""
    wanted = max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << min(20, (wanted - 1).bit_length())


def small_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A parameter table computed once and kept as local rows, or None when it has more than ``max_rows`` rows or is
    larger than 64 MB."""
    local = df.limit(max_rows + 1).toArrow()
    if local.num_rows > max_rows or local.nbytes > BROADCAST_BYTES:
        return None
    if local.num_rows == 0:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.createDataFrame(local, df.schema)


def settle(params: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a parameter table once: kept as local rows when it was counted to be small, otherwise checkpointed
    in the shared folder."""
    small = small_copy(params, max_rows)
    return cut_lineage(params) if small is None else small


def same_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the key columns of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    met = F.lit(True)
    for k in on:
        met = met & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, met, how).drop(*([] if how in ("left_semi", "left_anti") else [f"_right_{k}" for k in on]))


def join_params(
    rows: DataFrame, params: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS, null_safe: bool = False
) -> DataFrame:
    """Join rows to a parameter table: broadcast when the table was counted to be small, otherwise a plain
    equi-join that Spark may shuffle. With ``null_safe`` a null key meets a null key."""
    small = small_copy(params, max_rows)
    if null_safe:
        return same_keys(rows, params if small is None else F.broadcast(small), [on] if isinstance(on, str) else on, how)
    return rows.join(params, on, how) if small is None else rows.join(F.broadcast(small), on, how)


def ordered_position(
    df: DataFrame,
    groups: list[str],
    bucket: Column,
    order: list,
    pos: str = "pos",
    total: str = "n_group",
) -> DataFrame:
    """1-based position of each row in its group, with the group size.

    ``bucket`` must never decrease along ``order``. Each (group, bucket) is sorted on its own; the offsets
    come from a count per (group, bucket)."""
    rows, keys = _joinable_keys(df.withColumn("_bucket", bucket), groups)
    keys = [*keys, "_bucket"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys[:-1]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys[:-1])
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"),
        F.sum("_c").over(whole).alias(total),
    )
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # both sides are laid out by the same keys, so the rows are shuffled once, for the window
    return ranked.join(offsets, keys).withColumn(pos, F.col("_rn") + F.col("_offset")).drop(*keys, "_rn", "_offset")


def _joinable_keys(rows: DataFrame, groups: list[str]) -> tuple[DataFrame, list[str]]:
    """Key columns without nulls for the groups: the value or a stand-in, and one mask that tells which are null."""
    if not groups:
        return rows, []
    types = {f.name: f.dataType for f in rows.schema.fields}
    names = []
    for i, g in enumerate(groups):
        dtype = types[g]
        value = F.col(g) if isinstance(dtype, (T.NumericType, T.StringType)) else F.col(g).cast("string")
        filler = F.lit(0).cast(dtype) if isinstance(dtype, T.NumericType) else F.lit("")
        rows = rows.withColumn(f"_g{i}", F.coalesce(value, filler))
        names.append(f"_g{i}")
    mask = F.lit(0)
    for i, g in enumerate(groups):
        mask = mask + F.when(F.col(g).isNull(), 1 << i).otherwise(0)
    return rows.withColumn("_nulls", mask), [*names, "_nulls"]


def hash_position(
    df: DataFrame, groups: list[str], key: str, *salt, pos: str = "pos", total: str = "n_group"
) -> DataFrame:
    """Position in the shuffled order given by the row hash; ties of the hash are broken by the key."""
    width = HASH_RANGE // rank_buckets(df.sparkSession)
    rows = df.withColumn("_h", row_hash(key, *salt))
    return ordered_position(rows, groups, whole_div(F.col("_h"), width), ["_h", key], pos, total).drop("_h")


def deal(df: DataFrame, groups: list[str], key: str, salt: tuple, bounds: Callable[[DataFrame], DataFrame], out: str = "slice") -> DataFrame:
    """Each row's slice of its group in hash order, without moving the rows.

    ``bounds`` adds to a table (groups, ``n_group``) an array ``bounds`` of rising 0-based positions where the next slice
    begins; a row's slice is the number of bounds up to its position. Rows are counted per hash bucket; only the
    buckets that hold a bound are ranked, by hash and key alone, which gives the first row of each slice. Every row is then
    compared with these few rows. The key tells rows apart: rows with equal keys stay together.
    """
    on = groups or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(0))
    hashed = rows.withColumn("_h", row_hash(key, *salt))
    cuts = _first_rows(hashed, on, key, bounds)
    joined = join_params(hashed, cuts, on, null_safe=True)
    past = lambda c: (F.col("_h") > c["h"]) | ((F.col("_h") == c["h"]) & (F.col(key) >= c["key"]))
    placed = joined.withColumn(out, F.size(F.filter("_cuts", past))).drop("_cuts", "_h")
    return placed if groups else placed.drop("_all")


def _first_rows(hashed: DataFrame, on: list[str], key: str, bounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(groups, _cuts): hash and key of the first row of every slice but the first; slices at the end of a group may be empty."""
    width = HASH_RANGE // rank_buckets(hashed.sparkSession)
    bucketed = hashed.select(*on, "_h", F.col(key).alias("_key"), whole_div(F.col("_h"), width).alias("_bucket"))
    counted = settle(bucketed.groupBy(*on, "_bucket").agg(F.count(F.lit(1)).alias("_c")), max_rows=20 * BROADCAST_ROWS)
    sizes = settle(bounds(counted.groupBy(*on).agg(F.sum("_c").alias("n_group"))).select(*on, "n_group", "bounds"))
    upto = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    each = sizes.select(*on, F.posexplode("bounds").alias("_number", "_bound"))
    inside = (F.col("_bound") >= F.col("_before")) & (F.col("_bound") < F.col("_before") + F.col("_c"))
    wanted = settle(same_keys(placed, each, on).where(inside).select(*on, "_bucket", "_number", (F.col("_bound") - F.col("_before") + 1).alias("_nth")))
    ranked = join_params(bucketed, wanted.select(*on, "_bucket").distinct(), [*on, "_bucket"], "left_semi", null_safe=True)
    ranked = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(*on, "_bucket").orderBy("_h", "_key")).cast("bigint"))
    found = same_keys(ranked, wanted, [*on, "_bucket", "_nth"]).groupBy(*on).agg(F.collect_list(F.struct(F.col("_h").alias("h"), F.col("_key").alias("key"))).alias("_cuts"))
    kind = dict(bucketed.dtypes)["_key"]
    none = F.array().cast(f"array<struct<h:bigint,key:{kind}>>")
    return settle(same_keys(sizes, found, on, "left").select(*on, F.coalesce("_cuts", none).alias("_cuts")))


def running_sums(rows: DataFrame, order: list, **values: Column) -> DataFrame:
    """Each row with the sums of ``values`` over all rows up to it, under their names, and over those before it
    (``<name>_before``).

    Rows are cut into ranges of the order, kept in the shared folder, and each range is summed on its own; the
    driver sees one sum a range, from which every range gets what lies before it. Values must not be negative, and the order must
    tell rows apart."""
    held = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*order)
    held = cut_lineage(held.withColumn("_piece", F.spark_partition_id()))
    piece = Window.partitionBy("_piece").orderBy(*order)
    upto, before = (piece.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    sums = {n: F.sum(f"_v_{n}").over(upto) for n in values} | {f"{n}_before": F.sum(f"_v_{n}").over(before) for n in values}
    inside = held.withColumns(sums).drop(*[f"_v_{n}" for n in values])
    kinds = {n: inside.schema[n].dataType for n in values}
    offsets, so_far = [], [0.0 if isinstance(k, T.DoubleType) else 0 for k in kinds.values()]
    for end in inside.groupBy("_piece").agg(*[F.max(n).alias(n) for n in values]).orderBy("_piece").collect():
        offsets.append((end["_piece"], *so_far))
        so_far = [s + end[n] for s, n in zip(so_far, values)]
    shape = T.StructType([T.StructField("_piece", T.IntegerType()), *[T.StructField(f"_o_{n}", k) for n, k in kinds.items()]])
    joined = inside.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, shape)), "_piece")
    shifted = {n: F.col(n) + F.col(f"_o_{n}") for n in values}
    shifted |= {f"{n}_before": F.coalesce(f"{n}_before", F.lit(0).cast(k)) + F.col(f"_o_{n}") for n, k in kinds.items()}
    return joined.withColumns(shifted).drop("_piece", *[f"_o_{n}" for n in values])


MIDDLE = [0.499, 0.501]
ACCURACY = 10000


def middle_sketch(value: Column) -> Column:
    """Two values that enclose the median: a mergeable sketch whose rank error is at most 1 / 10,000 of the rows,
    asked for ranks ten times as far from the middle."""
    return F.percentile_approx(value, MIDDLE, ACCURACY)


def exact_median(df: DataFrame, groups: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group without holding a group's values in one task.

    Everything outside two enclosing values is only counted. The values between them are counted one by one in 1,024
    parts, and only the part that holds the middle rank is walked in order."""
    keys = groups or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    bounds = rows.groupBy(*keys).agg(middle_sketch(F.col("_v")).alias("_mid"), F.count(F.lit(1)).alias("_n"))
    low_v, high_v = F.col("_mid")[0], F.col("_mid")[1]
    between = F.col("_v").between(low_v, high_v)
    spread = F.least(F.floor((F.col("_v") - low_v) / (high_v - low_v) * 1024), F.lit(1023))
    part = F.when(F.col("_v") < low_v, -1).when(F.col("_v") > high_v, 1024).when(high_v > low_v, spread).otherwise(0)
    counted = (
        join_params(rows, bounds, keys)
        .select(*keys, part.cast("int").alias("_part"), F.when(between, F.col("_v")).alias("_k"), "_n")
        .groupBy(*keys, "_part", "_k")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    # which of the 1,026 parts hold the middle ranks
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    low, high = whole_div(F.col("_n") + 1, 2), whole_div(F.col("_n"), 2) + 1
    parts = counted.groupBy(*keys, "_part").agg(F.sum("_c").alias("_p"), F.max("_n").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_p").over(upto) - F.col("_p"))

    def holds(rank: Column, before: Column, count: Column) -> Column:
        return (before < rank) & (before + count >= rank)

    middle = parts.where(holds(low, F.col("_before"), F.col("_p")) | holds(high, F.col("_before"), F.col("_p")))
    walk = Window.partitionBy(*keys, "_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    walked = counted.join(middle.select(*keys, "_part", "_before"), [*keys, "_part"]).withColumn(
        "_prior", F.col("_before") + F.sum("_c").over(walk) - F.col("_c")
    )

    def at(rank: Column) -> Column:
        outside = F.raise_error(F.lit("median fell outside the sketch bounds")).cast("double")
        return F.max(F.when(holds(rank, F.col("_prior"), F.col("_c")), F.when(F.col("_k").isNotNull(), F.col("_k")).otherwise(outside)))

    result = walked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out))
    return result if groups else result.drop("_all")


def sorted_codes(values: DataFrame, groups: list[str], value: str, out: str = "code") -> DataFrame:
    """0-based place of each distinct text among the sorted texts of its group.

    A table counted to be small is sorted per group. A large one is cut by the three characters that follow the
    group's common prefix, and each piece is sorted on its own."""
    if small_count(values):
        return values.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(value)) - 1)
    ends = values.groupBy(*groups).agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    shortest = F.least(F.length("_first"), F.length("_last"))
    same = lambda i: F.substring("_first", F.lit(1), i) == F.substring("_last", F.lit(1), i)
    lengths = F.when(shortest > 0, F.filter(F.sequence(F.lit(1), shortest), same)).otherwise(F.array().cast("array<int>"))
    ends = ends.select(*groups, F.size(lengths).alias("_skip"))
    piece = F.substring(F.col(value), F.col("_skip") + 1, F.lit(3))
    ranked = ordered_position(join_params(values, ends, groups), groups, piece, [value])
    return ranked.withColumn(out, (F.col("pos") - 1).cast("int")).drop("pos", "n_group", "_skip")


def small_count(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``max_rows`` rows; stops counting beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def interval_step(size: Column) -> Column:
    """Block length for positions 0..size-1: about a thousand blocks, and no block shorter than 4,096."""
    return F.greatest(F.lit(4096), whole_div(size, 1024))


def interval_join(rows: DataFrame, slices: DataFrame, on: list[str], value: str, row_size: str, slice_size: str) -> DataFrame:
    """Rows to the half-open slice [lo, hi) that holds their position.

    Slices are cut at block borders, so this is an equi-join on (keys, block) that spreads a hot key over its
    blocks, and every row meets only the slices of its own block. Null keys are a group of their own. ``row_size`` and ``slice_size`` name the columns
    that carry the group size on either side; the number of slices after the cut stays near 1,000 per group."""
    width = interval_step(F.col(slice_size))
    blocks = F.sequence(whole_div(F.col("lo"), width), whole_div(F.col("hi") - 1, width))
    cut = slices.where(F.col("hi") > F.col("lo")).withColumn("_block", F.explode(blocks)).drop(slice_size)
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    blocked = rows.withColumn("_block", whole_div(F.col(value), interval_step(F.col(row_size))))
    return join_params(blocked, cut, [*on, "_block"], null_safe=True).where(inside).drop("_block")
