"""Query blocks against row blocks: searches whose every task holds one bounded block of each."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from centrum.llm.common import stored

#: Rows, on average, of a block that is searched, and of a block of queries.
ROWS, QUERIES = 16_384, 8_192


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """id and vector (doubles) of the rows that take part: no null id, no null or non-finite component."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    return rows.where(F.exists("vector", lambda x: x != 0)) if nonzero else rows


def matrix(rows: pa.Table, width: int) -> np.ndarray:
    """The vectors of a block as rows of doubles; shorter ones end in zeros."""
    column = rows.column("vector").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def top_k(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, best first, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]


def search(rows: DataFrame, every: int, k: int, score_type: str, block_search: Search) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for every row whose id is divisible by ``every``.

    Rows and queries fall into blocks by a hash of the id, so equal vectors spread; each pair of blocks is one group, which
    ``block_search`` answers with the best k rows of each query. Shards are merged by a window that keeps k rows a query.
    """
    rows = stored(rows, "vectors")
    query = F.pmod("id", F.lit(every)) == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q"), F.max(F.size("vector")).alias("width")).first()
    width = sizes["width"] or 0
    n_blocks, q_blocks = (max(1, math.ceil(sizes[c] / per)) for c, per in (("n", ROWS), ("q", QUERIES)))
    place = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks)).cast("int")
    asks = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(q_blocks)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(place.alias("block"), all_blocks(q_blocks).alias("asks"), "id", "vector")
    right = rows.where(query).select(all_blocks(n_blocks).alias("block"), asks.alias("asks"), "id", "vector")

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        ids, queries = (t.column("id").to_numpy() for t in (found, asked))
        answers = block_search(ids, matrix(found, width), queries, matrix(asked, width), k) if len(ids) and len(queries) else []
        sizes = [len(i) for i, _ in answers]
        empty = np.empty(0, np.int64)
        return pa.table({
            "query_id": np.repeat(queries[: len(sizes)], sizes).astype(np.int64),
            "vec_id": np.concatenate([i for i, _ in answers] or [empty]),
            "score": pa.array(np.concatenate([s for _, s in answers] or [empty])).cast(pa.float64() if score_type == "double" else pa.int64()),
        })

    near = left.groupBy("block", "asks").cogroup(right.groupBy("block", "asks")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
