"""Nearest neighbours over low-dimensional stable projections: a kd-tree yields projected neighbours until a chi-square test stops."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from centrum.llm.vector_blocks import search, top_k, usable

#: Projected dimensions (even, at most), the chance that a nearer row lies within the searched radius, points in a leaf,
#: leaves that are opened at once, rows that are verified between two tests. The first two were chosen by measured recall.
DIMENSIONS, CONFIDENCE, LEAF, LEAVES, STEP = 32, 0.82, 64, 64, 128


def chi_square(x: float, degrees: int) -> float:
    """P(X <= x) for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_bound(confidence: float, degrees: int) -> float:
    """The x with P(X <= x) = confidence."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < confidence:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < confidence else (low, middle)
    return high


class Tree:
    """A kd-tree: points in leaf order, cut at medians of the widest dimension, with the box of every leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, self.order, self.starts = [np.arange(len(points))], [], [0]
        while parts:
            part = parts.pop()
            if len(part) <= leaf:
                self.order.append(part)
                self.starts.append(self.starts[-1] + len(part))
                continue
            widest = int(np.ptp(points[part], axis=0).argmax())
            half = len(part) // 2
            cut = np.argpartition(points[part, widest], half)
            parts += [part[cut[half:]], part[cut[:half]]]
        self.order, self.starts = np.concatenate(self.order), np.array(self.starts)
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.starts[:-1])
        self.high = np.maximum.reduceat(self.points, self.starts[:-1])

    def leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their boxes, nearest first, and these distances."""
        away = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (away * away).sum(axis=1)
        order = np.argsort(far, kind="stable")
        return order, far[order]


def projections(width: int) -> np.ndarray:
    """Axes of the projected space: Gaussian ones, which are stable for the Euclidean norm, made orthogonal and scaled so that
    a squared projected distance still is the squared distance times the dimensions on average. Orthogonal axes spread
    less than independent ones, so the chi-square law errs on the side of searching on."""
    dimensions = min(DIMENSIONS, width - width % 2)
    gaussian = np.random.default_rng(11).standard_normal((width, dimensions))
    return np.linalg.qr(gaussian)[0] * math.sqrt(width)


class Index:
    """One shard. A last component lifts all rows to the norm ``longest``, so that nearest means largest inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.longest = longest
        lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        self.axes = projections(vectors.shape[1] + 1)
        self.tree = Tree(np.column_stack([vectors, lift]) @ self.axes)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]
        self.radius = chi_square_bound(CONFIDENCE, self.axes.shape[1])
        self.verified = 0  # rows whose inner product was computed, over all queries

    def projected(self, point: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows by squared projected distance, nearest first, and these distances: opened rows wait until no closed leaf can be nearer."""
        order, far = self.tree.leaves(point)
        rows, away = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), LEAVES):
            opened = np.concatenate([np.arange(self.tree.starts[i], self.tree.starts[i + 1]) for i in order[at : at + LEAVES]])
            gap = self.tree.points.take(opened, axis=0)
            gap -= point
            rows, away = np.concatenate([rows, opened]), np.concatenate([away, np.einsum("ij,ij->i", gap, gap)])
            ready = away <= (far[at + LEAVES] if at + LEAVES < len(order) else math.inf)
            turn = np.argsort(away[ready], kind="stable")
            yield rows[ready][turn], away[ready][turn]
            rows, away = rows[~ready], away[~ready]

    def best(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows found. A row nearer than the k-th best so far at distance d has a squared projected distance of
        at most d * d times a chi-square variable; once the next projected neighbour lies beyond that bound, the search stops."""
        ids, scores, length = np.empty(0, np.int64), np.empty(0), float(query @ query)
        for rows, away in self.projected(np.append(query, 0.0) @ self.axes):
            other = self.ids[rows] != own_id
            rows, away = rows[other], away[other]
            for at in range(0, len(rows), STEP):
                if len(scores) == k and away[at] > max(self.longest**2 + length - 2 * float(scores[-1]), 0.0) * self.radius:
                    return ids, scores
                some = rows[at : at + STEP]
                self.verified += len(some)
                ids, scores = top_k(np.concatenate([ids, self.ids[some]]), np.concatenate([scores, (self.vectors[some] * query).sum(axis=1)]), k)
        return ids, scores


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the largest inner products that the search finds.

    Queries are the rows whose id is divisible by ``every``; their own row is no candidate; scores are exact inner products of the
    original vectors in double precision; ties go to the smaller id; fewer candidates give fewer rows. Every row is in the
    index of its shard, and every query visits every shard. Rows with a null id, or a vector that is null, zero or
    holds null or non-finite components, take no part; unequal lengths end in zeros. An empty table gives no rows;
    other columns aren't read. Measured recall against brute force stands in the tests.
    """
    rows = usable(df, id_col, vector_col, nonzero=True)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm).alias("m")).first()["m"] or 0.0

    def run(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        index = Index(ids, vectors, longest)
        return [index.best(i, q, k) for i, q in zip(query_ids, queries)]

    return search(rows, every, k, "double", run)
