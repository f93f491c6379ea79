import math
import re
from collections import Counter

import numpy as np
import pytest

from centrum.llm import collocations, ranked_search

DOCS = "doc_id long, text string, lang string, id int, term string, shard int, n int"
BLOCK = "one two three four five six. "


def doc(i, text, lang="en"):
    return (i, text, lang, 0, "x", 0, 0)


def plain_phrases(rows, least):
    """Phrases, counted by slicing, with their lowest cuts and whether a longer one has the same count."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, k, l, r = min(cuts)
            longer = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            out[lang, " ".join(p)] = (a, n[lang], l, r, score, k, bool(longer))
    return out


@pytest.mark.parametrize("shard_words,few", [(1_000_000, 1_000_000), (9, 1_000_000), (9, 3)])
def test_phrases_equal_those_of_slicing(spark, monkeypatch, shard_words, few):
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", few)
    monkeypatch.setattr(collocations, "BROADCAST_WORDS", few)
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(list("abcdE"), 12)) + r.choice([".", ";\tx", "\n", "", " a a a a a"]) for _ in range(60)]
    rows = [doc(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows += [doc(None, None), doc(1, ""), doc(2, " \t .,;"), doc(3, BLOCK * 5), doc(3, BLOCK * 5), doc(4, "É é É é É é É é É é\x1cx é\x0bÉ", None), doc(5, "w " * 3000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain_phrases([(x[1], x[2]) for x in rows], 5)
    got = collocations.phrases(df, least=5, shard_words=shard_words).collect()
    assert {(g.lang, g.phrase): (g.a, g.n, g.l, g.r, g.score, g.cut, max(g.best_left, g.best_right) >= g.a) for g in got} == want
    assert len(got) == len(want) > 100


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([doc(1, None), doc(2, "a b c")], DOCS)
    assert collocations.phrases(df, least=5).collect() == []
    assert collocations.phrases(df.where("false"), least=5).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(1 << 50, (1 << 57) + 1, [1 << 51], [(1 << 50) + 12345], 2)]
    df = spark.createDataFrame(rows, "a long, n long, heads array<long>, tails array<long>, words int")
    assert df.select(collocations._lowest_cut().alias("c")).first().c.score == 1000 * (1 << 50) * ((1 << 57) + 1) // ((1 << 51) * ((1 << 50) + 12345))


def test_both_sides_of_an_index_agree():
    """Every interval, reached by any order of extensions, has the size of its phrase's count and lies in the intervals of its parts."""
    r = np.random.default_rng(5)
    codes = np.concatenate([[0], r.integers(0, 4, 400), [0]]).astype(np.uint16)
    sides = [collocations.Side(collocations.symbols_before(c)) for c in (codes, np.roll(codes[::-1], -1))]
    counts = Counter(tuple(codes[i : i + m].tolist()) for m in range(1, 6) for i in range(len(codes) - m + 1))
    counts = {p: c for p, c in counts.items() if 0 not in p}
    words = np.arange(1, 4, dtype=np.uint16)
    low = np.searchsorted(sides[0].first, words)
    intervals = [low, low, np.searchsorted(sides[0].first, words, "right") - low]
    known = [(int(w),) for w in words]
    for turn in (1, 0, 0, 1):
        found = collocations.longer(sides, intervals, np.arange(len(known)), turn)
        known = [known[p] + known[s][-1:] for p, s in zip(found["prefix"], found["suffix"])]
        intervals = [found[c].astype(np.int64) for c in ("low", "back_low", "size")]
        assert dict(zip(known, intervals[2].tolist())) == {p: c for p, c in counts.items() if len(p) == len(known[0])}


@pytest.mark.parametrize("held", [1 << 21, 5])
def test_counts_of_pairs_are_sent_packed(spark, monkeypatch, held):
    """Sums over all rows are exact, beyond 32 bits too, and a task sends a row for each group, not for each pair."""
    monkeypatch.setattr(collocations, "HELD_PAIRS", held)
    r = np.random.default_rng(7)
    pairs = [(int(p) << 33, int(s) + 5, int(n)) for p, s, n in zip(r.integers(0, 9, 2000), r.integers(0, 9, 2000), r.integers(1, 1 << 31, 2000))]
    df = spark.createDataFrame(pairs, "prefix long, suffix long, size long").repartition(3)
    want = Counter()
    for p, s, n in pairs:
        want[p, s] += n
    least = sorted(want.values())[20]
    got = collocations._counts(df, collocations._columns, 4, least)
    assert sorted(map(tuple, got.collect())) == sorted((p, s, n) for (p, s), n in want.items() if n >= least)
    assert collocations._counts(df.where("false"), collocations._columns, 4, least).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in plan and "hashpartitioning(prefix" not in plan


def test_packed_pairs_come_back_small():
    r = np.random.default_rng(8)
    keys = np.unique(r.integers(0, 20_000, 200_000) << 32 | r.integers(0, 20_000, 200_000))
    pairs = (keys >> 32 << 33, keys & 0xFFFFFFFF, r.integers(1, 3, len(keys)))
    data = collocations._pairs_packed(*pairs)
    assert [a.tolist() for a in collocations._pairs_unpacked(data)] == [a.tolist() for a in pairs]
    assert len(data) < 6 * len(keys)
    group = collocations._group_of(pairs[0], pairs[1], 50)
    assert np.bincount(group, minlength=50).max() < 1.1 * len(keys) / 50


def plain_search(docs, items, k):
    """Every score, by its formula."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings,size", [(4_000_000, 16 << 20), (40, 200)])
def test_search_equals_all_scores(spark, monkeypatch, postings, size):
    monkeypatch.setattr(ranked_search, "PASS_BYTES", size)
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "日本", "x_y", "A-b", "\x1c"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = [doc(i, " ".join(r.choice(words, r.integers(1, 40), p=share / share.sum()))) for i in range(300)]
    rows += [doc(5, rows[5][1])] * 12 + [doc(None, rows[7][1]), doc(900, None), doc(901, ""), doc(902, " -_. "), doc(903, "w1 W2 " * 20_000)]
    items = [(i, " ".join(r.choice(words, 12)), 0) for i in range(15)] + [(15, None, 0), (16, "", 0), (17, "nowhere", 0), (None, "w1", 0), (18, "w1 w1 W1", 0), (18, "日本", 0), (19, rows[5][1], 0)]
    df, asked = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id int, text string, n int")
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    got = ranked_search.search(df, asked, k=10)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_search([(x[0], x[1]) for x in rows], [(x[0], x[1]) for x in items], 10)


def test_search_of_nothing(spark):
    df, asked = spark.createDataFrame([doc(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked_search.search(df.where("false"), asked).collect() == []
    assert ranked_search.search(df, asked.where("false")).collect() == []
    # one document holds the term: floor(1000 * ln(4 / 3)) thousandths
    assert [tuple(x) for x in ranked_search.search(df, asked).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // (1000 + 8 * 100)))]


def test_accumulators_stop_and_results_stay():
    """With a rare and a frequent term, only documents of the rare one get accumulators."""
    n = np.full(1000, 10)
    terms = np.concatenate([np.zeros(20, np.int64), np.ones(1000, np.int64)])
    owner = np.concatenate([np.arange(0, 1000, 50), np.arange(1000)])
    shard = ranked_search._Shard(n, terms, owner, np.ones(1020, np.int64), np.array([4000, 1]), 1000, 10_000)
    made, score = shard.search(np.array([0, 1]), 10, 1, np.zeros(1000, np.int64))
    assert set(made) <= set(range(0, 1000, 50)) and len(made) >= 10 and len(set(score.tolist())) == 1
