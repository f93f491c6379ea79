"""Exact top-k search over integer impacts by MaxScore: essential postings are traversed, others probed while competitive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from centrum.llm.vector_blocks import search, top_k, usable

#: Rows that are traversed before the threshold is raised again, terms probed between two looks at the bound, and
#: strongest terms whose best rows give the first threshold.
STEP, PROBE, SEEDS = 4_096, 4, 8


def quantised(vectors: np.ndarray, scale: float = 64.0) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


class Postings:
    """One shard: a list of impacts for each term, in the order of ids, with the list's extremes as bounds."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(impacts[order].T)
        self.high, self.low = self.lists.max(axis=1), self.lists.min(axis=1)
        self.summed = 0  # impacts read, over all queries

    def seed(self, own_id: int, weights: np.ndarray, terms: np.ndarray, k: int) -> int | None:
        """The k-th best whole score among the rows that are best by the strongest terms: a threshold that k rows reach."""
        rows = np.flatnonzero(self.ids != own_id)
        if len(rows) < k or not len(terms):
            return None
        strongest = terms[np.argsort(-np.abs(weights[terms]), kind="stable")[:SEEDS]]
        partial = weights[strongest] @ self.lists[strongest][:, rows]
        some = min(len(rows), 4 * k)
        rows = rows[np.argpartition(-partial, some - 1)[:some]]
        self.summed += len(strongest) * len(partial) + len(terms) * some
        return int(np.sort(weights[terms] @ self.lists[np.ix_(terms, rows)])[-k])

    def best(self, own_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows with the highest sums of weight times impact, but for the query's own.

        A term adds between its lower and its upper bound. With terms sorted by what they can add above the lower bound,
        the essential ones come first: rows that show nothing above the lower bounds there can't reach the threshold.
        """
        upper, lower = np.maximum(weights * self.high, weights * self.low), np.minimum(weights * self.high, weights * self.low)
        terms = np.argsort(lower - upper, kind="stable")
        terms = terms[weights[terms] != 0]
        left = np.append(np.cumsum(upper[terms][::-1])[::-1], 0)
        base = np.append(0, np.cumsum(lower[terms]))
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        least = self.seed(own_id, weights, terms, k)
        for first in range(0, len(self.ids), STEP):
            last = min(first + STEP, len(self.ids))
            beaten = base + left < least if least is not None else np.zeros(len(left), bool)
            essential = int(beaten.argmax()) if beaten.any() else len(terms)
            head = min(essential, 2 * PROBE)
            rows, sums = np.arange(first, last), np.zeros(last - first, np.int64)
            for t in terms[:head]:
                sums += weights[t] * self.lists[t, first:last]
            self.summed += head * len(rows)
            other = self.ids[first:last] != own_id
            rows, sums = rows[other], sums[other]
            for at in [*range(head, essential, PROBE), *range(essential, len(terms), PROBE)]:
                if least is not None:
                    rows, sums = _competitive(rows, sums, left[at], least)
                probed = terms[at : min(at + PROBE, essential if at < essential else len(terms))]
                self.summed += len(probed) * len(rows)
                for t in probed:
                    sums += weights[t] * self.lists[t].take(rows)
            ids, scores = top_k(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, sums]), k)
            if len(scores) == k:
                least = max(int(scores[-1]), least) if least is not None else int(scores[-1])
        return ids, scores


def _competitive(rows: np.ndarray, sums: np.ndarray, left: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can still reach the threshold; equal sums stay for the tie on ids."""
    keep = sums + left >= least
    return rows[keep], sums[keep]


def _search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    shard = Postings(ids, quantised(vectors))
    return [shard.best(i, w, k) for i, w in zip(query_ids, quantised(queries))]


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the exact k highest integer inner products of floor(64 * x) for each query.

    Queries are the rows whose id is divisible by ``every``; their own row is no candidate; ties go to the smaller id;
    fewer candidates give fewer rows. Rows with a null id, a null vector, or a null or non-finite component take no part;
    vectors of unequal length end in zeros. Sums must fit 64 bits. Rows with equal ids are candidates each for
    itself, but never for a query of that id. An empty table gives no rows; other columns aren't read.
    """
    return search(usable(df, id_col, vector_col, nonzero=False), every, k, "long", _search)
