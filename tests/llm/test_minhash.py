import random

import numpy as np
import pytest

from centrum.llm import minhash
from centrum.llm.components import components

SCHEMA = "doc_id long, text string, bucket string, node long"


def brute(rows, size, per_cent):
    """Component of every id by comparing all pairs of whole sets."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=r.choice([5, 30, 80, 200]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 220):
        t = r.choice(base[:25]).split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    chain = r.choices(words, k=120)
    for i in range(220, 260):  # each like the one before, the ends unlike each other
        chain = chain[2:] + r.choices(words, k=2)
        rows.append((i, " ".join(chain)))
    rows += [(260, None), (261, ""), (262, " \t\n"), (263, "one"), (264, "ONE"), (265, "two words"), (266, "x" * 100_000), (267, "x" * 100_000)]
    rows += [(268 + k, "hot text of many copies that are all the same") for k in range(120)]
    return rows


@pytest.mark.parametrize("size,per_cent", [(3, 85), (5, 80)])
def test_components_equal_those_of_all_pairs(spark, size, per_cent):
    rows = planted()
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=size, per_cent=per_cent).collect()}
    want = brute(rows, size, per_cent)
    assert got == want


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c d", "", 0), (None, "lonely text here now", "", 0), (4, "a b c d", "", 0), (4, "a b c d", "", 0), (9, "A B C d", "", 0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 4, False), (None, None, True), (4, 4, True), (4, 4, True), (9, 4, False)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_is_circulant_and_estimates_similarity():
    table = minhash._permuted()
    x = np.array([12345], np.uint64)
    place = int((minhash._mixed(x + minhash._MIX[0]) & np.uint64(minhash.DOMAIN - 1))[0])
    assert (minhash.signature(x) == table[place : place + minhash.COORDINATES]).all()
    assert sorted(table[: minhash.DOMAIN]) == list(range(minhash.DOMAIN))
    a = np.arange(1000, dtype=np.uint64)
    same = (minhash.signature(a) == minhash.signature(a[150:])).mean()
    assert abs(same - 0.85) < 0.12


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(150, 150), (151, 150), (150, 151)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {150: 150, 151: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fringe_of_a_large_group_meets_by_its_rarest_shingles(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([1, 2, 4, 5, 6])):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], [f"x{r.randrange(3)}"]])
        rows.append((i, " ".join(words)))
    sizes, whole = [], minhash._prefix_pairs

    def counted(*args):
        pairs = whole(*args)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_prefix_pairs", counted)
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=3, per_cent=85).collect()}
    assert got == brute(rows, 3, 85)
    assert len(sizes) == 1


def test_members_of_a_large_group_are_not_carried_along(spark, monkeypatch):
    """Rows that go from round to round grow no faster than the group, and are few beside its members."""
    held = {}
    store = minhash.stored

    def counted(df, name):
        out = store(df, name)
        held.setdefault(name, []).append(out.count() if name == "members" else 0)
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    carried = {}
    for copies in (100, 400):
        r = random.Random(5)
        words = [f"w{k}" for k in range(400)]
        base = r.choices(words, k=60)
        texts = []
        for _ in range(copies):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        held.clear()
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, size=3, per_cent=85).collect()}
        assert got == brute(rows, 3, 85)
        everything, fitting, *rest = held["members"]
        carried[copies] = sum(rest)
        assert fitting <= everything and all(n < 0.7 * everything for n in rest) and rest == sorted(rest, reverse=True)
    assert carried[400] <= 8 * carried[100] + 100
