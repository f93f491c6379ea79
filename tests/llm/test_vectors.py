import math

import numpy as np
import pytest

from centrum.llm import maxscore, projected_neighbours as pn, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, id int, vector string, block int"


def rows(n=700, seed=2, width=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    x = (centres[r.integers(0, 12, n)] + 0.7 * r.normal(size=(n, width))).astype(np.float32)
    x[50:90] = x[40]  # ties
    out = [(i, x[i].tolist(), 0, 1, "clash", 2) for i in range(n)]
    out[3] = (3, None, 0, 1, "", 2)
    out[20] = (20, [math.nan] + [1.0] * (width - 1), 0, 1, "", 2)
    out[40 + 1] = (41, [None] + [1.0] * (width - 1), 0, 1, "", 2)
    out[60] = (60, [0.0] * width, 0, 1, "", 2)
    out[80] = (80, [math.inf] + [1.0] * (width - 1), 0, 1, "", 2)
    return out


def brute(data, score, nonzero, k=20):
    good = {r[0]: np.array(r[1], np.float64) for r in data if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and (not nonzero or any(r[1]))}
    out = {}
    for q in good:
        if q % 20 == 0:
            found = sorted((-score(good[q], good[c]), c) for c in good if c != q)[:k]
            out[q] = [(c, -s) for s, c in found]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("sizes", [(16384, 2048), (150, 9)])
def test_exact_search_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(vector_blocks, "ROWS", sizes[0])
    monkeypatch.setattr(vector_blocks, "QUERIES", sizes[1])
    monkeypatch.setattr(maxscore, "STEP", 64)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = answers(maxscore.exact_top_k(df))
    assert got == brute(rows(), lambda a, b: int(np.floor(64 * a).astype(int) @ np.floor(64 * b).astype(int)), False)


def test_pruned_shard_search_equals_brute_force():
    r = np.random.default_rng(4)
    x = r.integers(-40, 41, (20_000, 64))
    shard = maxscore.Postings(np.arange(20_000), x)
    for q in range(0, 200, 20):
        ids, scores = shard.best(q, x[q], 20)
        s = x @ x[q]
        s[q] = -(10**9)
        order = np.lexsort((np.arange(len(s)), -s))[:20]
        assert ids.tolist() == order.tolist() and scores.tolist() == s[order].tolist()


def test_nearest_reaches_the_recall(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got, want = answers(pn.nearest(df)), brute(rows(), lambda a, b: float(a @ b), True)
    assert got.keys() == want.keys()
    hits = sum(s >= want[q][-1][1] - 1e-9 for q in want for _, s in got[q])
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {r[0]: np.array(r[1], np.float64) for r in rows() if r[1] and None not in r[1]}
    assert all(abs(s - float(exact[q] @ exact[c])) < 1e-9 for q in got for c, s in got[q])


@pytest.mark.parametrize("block", [16384, 500])
def test_recall_on_the_given_vectors(spark, folder, monkeypatch, block):
    monkeypatch.setattr(vector_blocks, "ROWS", block)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = answers(pn.nearest(df))
    data = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    want = brute(data, lambda a, b: float((a * b).sum()), True)
    hits = sum(len({c for c, _ in want[q]} & {c for c, _ in got[q]}) for q in want)
    assert hits >= 0.92 * sum(map(len, want.values()))


def grouped(n, seed=9, groups=60, width=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, width))[r.integers(0, groups, n)] + 1.2 * r.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_the_stopping_test_holds_before_all_is_verified():
    x, queries = grouped(8_000), range(0, 8_000, 160)
    shard = pn.Index(np.arange(8_000), x, 1.0)
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -9
        hits += len(set(shard.best(q, x[q], 20)[0].tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(queries)
    assert shard.verified <= 0.3 * 8_000 * len(queries)


def test_projected_neighbours_come_nearest_first():
    x = grouped(3_000)
    shard = pn.Index(np.arange(3_000), x, 1.0)
    point = np.append(x[7], 0.0) @ shard.axes
    found = list(shard.projected(point))
    rows, away = (np.concatenate(part) for part in zip(*found))
    assert sorted(rows.tolist()) == list(range(3_000)) and (np.diff(away) >= 0).all()
    assert np.allclose(away, ((shard.tree.points[rows] - point) ** 2).sum(axis=1))


def test_projections_keep_distances_on_average():
    axes = pn.projections(65)
    assert axes.shape == (65, pn.DIMENSIONS) and np.allclose(axes.T @ axes, 65 * np.eye(pn.DIMENSIONS))
    assert pn.projections(4).shape == (4, 4) and pn.projections(3).shape == (3, 2)


def test_first_threshold_is_reached_by_k_rows():
    r = np.random.default_rng(5)
    x = r.integers(-40, 41, (5_000, 64))
    shard = maxscore.Postings(np.arange(5_000), x)
    terms = np.flatnonzero(x[0])
    least = shard.seed(0, x[0], terms, 20)
    s = np.delete(x @ x[0], 0)
    assert (s >= least).sum() >= 20 and least > np.median(s)
    assert shard.seed(0, x[0], terms, 5_000) is None
    shard.summed = 0
    shard.best(0, x[0], 20)
    assert shard.summed < 0.95 * x.size


def test_few_rows_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, "", 0), (5, [2.0], 0, 0, "", 0), (7, [0.5, 3.0, 1.0], 0, 0, "", 0)], SCHEMA)
    assert answers(maxscore.exact_top_k(few)) == {0: [(7, 64 * 32 + 128 * 192), (5, 64 * 128)]}
    assert answers(pn.nearest(few)) == {0: [(7, 6.5), (5, 2.0)]}
    for search in (maxscore.exact_top_k, pn.nearest):
        assert search(spark.createDataFrame([], SCHEMA)).collect() == []
        assert search(few.where("vec_id = 0")).collect() == []


def test_chi_square():
    assert abs(pn.chi_square_bound(0.95, 2) - 5.991) < 0.001
    assert abs(pn.chi_square_bound(0.99, 12) - 26.217) < 0.001
