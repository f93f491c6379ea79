import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from centrum.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe._table(PATH).merges


def test_odd_texts_are_the_librarys(spark, library):
    from tests.llm.test_text_models import ODD

    rows = [(i, t, 0, "x") for i, t in enumerate(ODD)] + [(None, "null id", 0, ""), (3, "", 0, ""), (3, "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, ids string").repartition(3)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_and_decode(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_and_decode(df.where("false"), PATH).collect() == []


def test_random_texts_are_the_librarys(library):
    r = random.Random(11)
    tokens = [t.replace("</w>", "") for t in library.get_vocab()]
    bits = [" ", "<|endoftext|>", "!!!", "aaaa", "日", "\x85", "\x1c", "'s", "'S", "12", "é", "é", "İ", "ς", "<", "|>", "</w>"]
    makers = [lambda: "".join(r.choice(tokens) for _ in range(r.randint(1, 4))), lambda: "".join(r.choice("aehst") for _ in range(r.randint(1, 40))), lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 9)))]
    texts = [r.choice(makers)() for _ in range(3000)] + ["x" * 3000, "ha" * 2000, "-" * 3001]
    ids, sizes, decoded = bpe._encoded(bpe._table(PATH), texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for own in want for i in own] and sizes.tolist() == list(map(len, want))
    assert decoded == [library.decode(own, skip_special_tokens=False) for own in want]


def test_speculation_gives_what_merging_gives(merges):
    r = random.Random(12)
    parts = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14))) for _ in range(5000)] + ["a" * k for k in range(1, 40)]
    fast, slow = merges.encode(parts), merges.merge(parts)
    assert (fast[0] == slow[0]).all() and (fast[1] == slow[1]).all()


def test_only_failing_parts_are_merged(merges, monkeypatch):
    calls = []
    whole = merges.merge
    monkeypatch.setattr(merges, "merge", lambda parts: calls.append(parts) or whole(parts))
    assert merges.encode(["the", "house"])[1].tolist() == [1, 1] and not calls


def test_neighbours_stay_apart_exactly_if_merging_keeps_them(merges):
    """Pairs of tokens, against merging their letters, with equal ranks on both sides among them."""
    r = np.random.default_rng(13)
    name = {i: t for t, i in Tokenizer.from_file(PATH).get_vocab().items()}
    inner = [i for i in np.flatnonzero(merges.proper[: merges.size]) if i in name and not name[i].endswith("</w>")]
    last = [i for i in np.flatnonzero(merges.proper[: merges.size]) if i in name and name[i].endswith("</w>")]
    a, b = r.choice(inner, 4000), r.choice(last, 4000)
    doubled = [i for i in inner if name[i] == name[i][:1] * len(name[i])]
    a = np.concatenate([a, doubled])
    b = np.concatenate([b, [merges.letters[name[i][:1] + "</w>"] for i in doubled]])
    apart = merges.apart(a, b)
    ids, counts = merges.merge([name[x] + name[y].removesuffix("</w>") for x, y in zip(a, b)])
    first = np.cumsum(counts) - counts
    kept = (counts == 2) & (ids[first] == a)
    assert (apart == kept).all() and 0 < apart.sum() < len(apart)


def test_marks_and_capitals_leave_no_new_words(library):
    table = bpe._Words(PATH)
    texts = ["House, house; HOUSE.\nhouse! It's (house)", "", "house's\nIT'S,"]
    ids, sizes, decoded = bpe._encoded(table, texts)
    assert set(table.place) == {"", "house", ",", ";", ".", "!", "it", "'s", "(house", ")"}
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert decoded == [library.decode(own, skip_special_tokens=False) for own in want]


@pytest.mark.parametrize("apart", [True, False])
def test_words_split_at_marks_are_the_librarys(library, apart):
    """Special strings, contractions and joined marks beside letters and line ends, with and without the split."""
    r = random.Random(14)
    bits = ["House", "it", "K", "É", "e\u0301", "E\u0301", "\u0301", "\u0338", "=", "<", "|", "<|endoftext|>", "<|EndOfText|>", "endoftext|>", "'S", "'ll", "'", ",", "...", "\n", "\r\n", "\t", " ", "7", "Σ", "ς", "日"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(4000)]
    table = bpe._Words(PATH)
    assert table.apart
    table.apart = apart
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 10):  # few together, as one special string keeps all their capitals
        ids, sizes, decoded = bpe._encoded(table, texts[a : a + 10])
        assert ids.tolist() == sum(want[a : a + 10], []) and sizes.tolist() == list(map(len, want[a : a + 10]))
        assert decoded == [library.decode(own, skip_special_tokens=False) for own in want[a : a + 10]]
