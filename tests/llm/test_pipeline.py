"""Every stage of the pipeline against plain Python, with names that clash, nulls and repeated rows."""

import re

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from centrum.llm import language_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, spans string, accepted boolean, content string, row int, label int, node int, value string"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), 7, "s", False, "c", 1, 2, 3, "v")


@pytest.fixture(scope="module")
def prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(700).collect()
    return [doc(r.doc_id, r.text, r.lang, r.source) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_languages(spark, prose):
    odd = [doc(9001, None), doc(9002, ""), doc(9003, "12 !?"), doc(None, "жщ цчш " * 60, None), doc(9004, "жщ цчш " * 60, None), doc(None, prose[0][1])]
    df = frame(spark, prose + odd + prose[:3])
    models = language_id.fit(df.where(~language_id.held_out()))
    accepted = {r.text for r in language_id.score(df.select("text"), models, "text", "text").where("accepted").collect()}
    got = cp.keep_known_languages(spark, df, "")
    assert got.schema == df.schema
    assert plain(got) == sorted((r for r in prose + odd + prose[:3] if r[1] in accepted), key=str)
    assert not accepted & {None, "", "12 !?", "жщ цчш " * 60} and prose[0][1] in accepted
    assert plain(cp.keep_known_languages(spark, df.where("false"), "")) == []


def test_near_duplicates(spark):
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words, 60)) for _ in range(6)]
    near = [b.rsplit(" ", 2)[0] + " x y" for b in base[:3]]
    far = [" ".join(reversed(b.split())) for b in base[:2]]
    texts = base + near + far + [base[0].upper(), None, "", "short one", "short one"]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(1, base[1]), doc(None, "alone " * 9), doc(None, "alone again " * 9), doc(None, base[2])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    want = [rows[i] for i in range(len(texts)) if group[i] == i] + [doc(None, "alone " * 9), doc(None, "alone again " * 9)]
    got = cp.keep_one_of_each_group(spark, frame(spark, rows), "")
    assert plain(got) == sorted(want, key=str) and len(want) < len(rows) - 3
    assert plain(cp.keep_one_of_each_group(spark, frame(spark, rows).where("false"), "")) == []


def test_secrets(spark):
    live, copied = "password = 'Zx9Qw8Er7Ty6Ui5O'", "token: abcdefgh12345678"
    rows = [doc(1, f"Here is {live}, é {copied} end", source="a"), doc(2, f"{copied} again", source="b"), doc(3, f"and {copied}", source="c"), doc(4, None), doc(5, ""), doc(6, "nothing"),
            doc(1, f"Here is {live}, é {copied} end", source="a"), doc(None, f"x {live}", source="a"), doc(7, "AKIA" + "Q7" * 8 + " and " + "0f" * 20, source="a")]
    hide = lambda t: t if t is None else re.sub(r"AKIA[A-Z0-9]+|(?:0f){20}", "<secret>", t.replace(live[:-1], "<secret>"))
    want = [(*r[:1], hide(r[1]), *r[2:4], len(hide(r[1]) or ""), *r[5:]) for r in rows]
    assert plain(cp.hide_live_secrets(spark, frame(spark, rows), "")) == sorted(want, key=str)
    assert plain(cp.hide_live_secrets(spark, frame(spark, rows).where("false"), "")) == []


def test_sequences(spark, prose):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = prose[:40] + [doc(9001, None), doc(9002, ""), doc(9003, "z " * 5000)]
    got = cp.pack_sequences(spark, frame(spark, rows), "").collect()
    for r in rows:
        own = sorted((g.start, bytes(g.ids)) for g in got if g.doc_id == r[0])
        assert b"".join(x for _, x in own) == np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert cp.pack_sequences(spark, frame(spark, rows).where("false"), "").collect() == []


def test_run_passes_each_stage_what_the_last_one_kept(spark, folder):
    got = cp.run(spark, folder).select("doc_id").distinct().count()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:2]:
        docs = stage(spark, docs, folder)
    assert got == docs.select("doc_id").distinct().count() > 0
