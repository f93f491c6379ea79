import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from centrum.llm import common, language_id, packing, pieces, queries, token_counts

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "x\ty z", "\n\nfoo \n bar  \n", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "<|startoftext|>x <|startoftext|>", "a ▁ b▁ ▁c ▁▁d", "日本語 テキスト です",
    "é é e ́x", "a b  c", "it's don't we'll 's 12 345 1 2", "x  y 　z", "a \x1c b\x1d c \x85 d", "1" * 50 + " " + "☃ 😀 😀😀 x", "<s> </s> <unk> <0x41>", "ΑΣ ΣΑΣ ς", "a  ", "   a", "İstanbul ǅ ŉ ſ K",
    "word " * 30_000, "x" * 5_000, ("abc " * 50 + "\n") * 40,
]
SCHEMA = "doc_id long, text string, lang string, id int, n int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0, 1) for i, t in enumerate(ODD)] + [(None, "null id", "", 0, 0), (3, "", "", 0, 0)], SCHEMA).repartition(3)


def rows_of(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_token_counts_are_the_librarys(odd, monkeypatch, part):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = ordered((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows_of(odd))
    got = token_counts.with_token_counts(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert ordered(tuple(r) for r in got.collect()) == want
    table = token_counts._Lengths(public_tokenizers.path("byte_bpe_50k.json"))
    for _, x in rows_of(odd):
        parts = token_counts.safe_parts(x, part)
        assert table.count(parts, [k > 0 for k in range(len(parts))]).sum() == len(t.encode(x, add_special_tokens=False).ids)


def test_piece_ids_and_decoded_texts_are_the_librarys(odd):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = ordered((i, p.encode(x), p.decode(p.encode(x)) if x else "") for i, x in rows_of(odd))
    got = pieces.encode_and_decode(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert ordered((r.doc_id, list(r.ids), r.decoded) for r in got.collect()) == want


def test_small_tables_change_nothing(odd):
    table = pieces._table(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [x for _, x in rows_of(odd)]
    table.clear()
    table.limit, before = 3, pieces._encoded(table, texts)
    again = [pieces._encoded(table, [x]) for x in texts]
    table.limit = 500_000
    assert np.concatenate([a[0] for a in again]).tolist() == before[0].tolist()
    assert [a[2][0] for a in again] == before[2]


def check_packing(rows, want_ids, window):
    """Every token once, sequences without gaps and within the window; the share of padding."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want_ids.items():
        got = sorted(docs.pop(i))
        assert b"".join(p[2] for p in got) == np.array(ids, "<u4").tobytes()
        assert [p[0] for p in got] == np.cumsum([0] + [p[1] for p in got[:-1]]).tolist() and {p[3] for p in got} == {len(ids)}
    assert not docs
    padding = 0
    for pieces_in in sequences.values():
        at = 0
        for offset, length in sorted(pieces_in):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, sum(len(x) for x in want_ids.values()))


def test_packing_places_every_token_once(spark, odd, folder):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 10_000, "text"))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    encoded = packing.word_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    for window, group in ((2048, 8_000_000), (512, 20_000)):
        assert check_packing([r.asDict() for r in packing.pack(encoded, window, group).collect()], want, window) == 0
    assert packing.pack(encoded.where("false")).collect() == []


def test_a_packing_group_is_cut_in_small_batches_by_a_worker_without_words():
    rng = np.random.default_rng(3)
    want = [rng.integers(0, 60_000, n).tolist() for n in [0, 1, 5_000, 2_048, 0, *rng.integers(0, 4_000, 400)]]
    data = [np.array(x, "<u4" if i % 3 else "<u2").tobytes() for i, x in enumerate(want)]
    rows = pa.table([range(len(want)), pa.array(data, pa.binary()), [len(x) for x in want]], ["id", "ids", "n"])
    rows = pa.concat_tables([rows.slice(0, 7), rows.slice(7, 200), rows.slice(207)])
    triples = packing.combinations(2048)
    histogram = np.bincount([len(x) % 2048 for x in want], minlength=2048).astype(float)
    common.held("words", dict)
    batches = list(packing._packed(rows, 0, 2048, triples, packing.repeat_counts(histogram, triples) / len(want)))
    assert common._held == {}
    assert len(batches) > 1 and all(b.column("ids").nbytes <= 1.01 * common.SLICE_BYTES for b in batches)
    pieces = pa.Table.from_batches(batches).to_pylist()
    assert check_packing(pieces, {i: x for i, x in enumerate(want) if x}, 2048) == 0


def test_texts_without_tokens_give_no_piece(spark):
    none = spark.createDataFrame([(1, b"", 0), (2, b"", 0)], "id long, ids binary, n long")
    assert packing.pack(none).collect() == []


def test_texts_are_taken_from_a_column_run_by_run():
    column = pa.array(["skipped", "a" * 5, None, "é" * 9, "", "b"]).slice(1)
    assert list(common.text_slices(column, 8)) == [(0, ["a" * 5, ""]), (2, ["é" * 9]), (3, ["", "b"])]
    assert list(common.text_slices(column.slice(0, 0))) == []


def test_least_squares_fits_the_histogram():
    triples = packing.combinations(64)
    assert (triples.sum(axis=1) == 64).all() and len(np.unique(triples, axis=0)) == len(triples)
    true = np.random.default_rng(1).integers(0, 9, len(triples)) * (np.random.default_rng(2).random(len(triples)) < 0.2)
    goal = np.bincount(triples.ravel(), np.repeat(true, 3), 65)
    goal[0] = 0
    x = packing.repeat_counts(goal[:65], triples, 2000)
    got = np.bincount(triples.ravel(), np.repeat(x, 3), 65)
    assert (x >= 0).all() and np.abs(got[1:] - goal[1:]).max() < 0.01 * goal.max()


def test_packing_query_gives_checksums_of_the_ids(spark, folder):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op10(spark, folder).collect():
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_languages_are_told_apart_on_held_out_rows(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op1(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_shares_add_up_to_one():
    grams, owner = language_id.events(["banana", "bandana", "cabana-nab", "123", ""])
    assert sorted(set(owner.tolist())) == [0, 1, 2]
    kinds, counts = np.unique(grams, axis=0, return_counts=True)
    alphabet = np.unique(grams)
    model = language_id.fit_model("x", kinds, counts.astype(float), len(alphabet))
    for context in ([32, 32, 32, 32], [98, 97, 110, 97], [97, 98, 99, 100]):
        rows = np.array([[*context, c] for c in [*alphabet, 9999]], np.uint32)
        assert abs(np.exp(model.log_shares(rows)).sum() - 1) < 1e-9


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney with dictionaries: a function from a tuple of four codes and a next one to its share."""
    counts = [Counter() for _ in range(6)]
    grams, _ = language_id.events(texts)
    counts[5].update(tuple(g) for g in grams.tolist())
    for order in range(4, 0, -1):
        for gram in counts[order + 1]:
            counts[order][gram[1:]] += 1
    alphabet = len({c for g in counts[5] for c in g})
    discount, totals, kinds = {}, {}, {}
    for order in range(1, 6):
        once, twice = (sum(n == k for n in counts[order].values()) for k in (1, 2))
        discount[order] = once / (once + 2 * twice) if once and twice else 0.5
        for gram, n in counts[order].items():
            totals[gram[:-1]] = totals.get(gram[:-1], 0) + n
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1

    def share(context, c):
        p = 1 / (alphabet + 1)
        for order in range(1, 6):
            before = context[5 - order :]
            if before in totals and len(before) == order - 1:
                n = counts[order].get((*before, c), 0)
                p = max(n - discount[order], 0) / totals[before] + discount[order] * kinds[before] / totals[before] * p
        return p

    return share


def test_cross_entropy_is_that_of_plain_kneser_ney(spark):
    texts = {"aa": ["lala mola lo", "mola mala", "alo lom ola"], "bb": ["tkrz brk", "krz tbr kk", "zzrk"]}
    rows = [(5 * i + 1, t, lang, 0, 0) for lang, own in texts.items() for i, t in enumerate(own * 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    models = language_id.fit(df)
    tune = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    asked = ["mola krz", "ola", "unseen жx", "la " * 3000]
    got = {r.text: r.cross_entropy for r in language_id.score(spark.createDataFrame([(t,) for t in asked], "text string"), models, "text", "text").collect()}
    plain = [plain_kneser_ney([w for i, t, x, *_ in rows if x == lang and i not in tune for w in t.split()]) for lang in ("aa", "bb")]
    for text in asked:
        grams, _ = language_id.events(text.split(" "))
        entropy = [-sum(math.log(share(tuple(g[:4]), g[4])) for g in grams.tolist()) / len(grams) for share in plain]
        assert got[text] == pytest.approx(min(entropy), rel=1e-5)


def test_few_clean_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.fit(docs.where(~language_id.held_out()))
    own = language_id.score(docs.where(language_id.held_out()), models).where("n > 0")
    assert own.where("not accepted").count() <= 0.01 * own.count()


def test_languages_of_odd_rows(spark):
    train = spark.createDataFrame([(i, w * 30, lang, 0, 0) for i in range(40) for lang, w in (("aa", "lala mola "), ("bb", "tkrz brk "))], SCHEMA)
    models = language_id.fit(train)
    assert [m.name for m in models] == ["aa", "bb"]
    odd = spark.createDataFrame([(1, "la mola", None, 0, 0), (1, "la mola", None, 0, 0), (None, "krz", "aa", 0, 0), (4, None, "aa", 0, 0), (5, "12 !?", "aa", 0, 0), (6, "жжжж щщщщ " * 20, "aa", 0, 0)], SCHEMA)
    got = sorted((r.doc_id or 0, r.lang_pred, r.accepted) for r in language_id.score(odd, models).collect())
    assert [g[:2] for g in got[:5]] == [(0, "bb"), (1, "aa"), (1, "aa"), (4, "und"), (5, "und")]
    assert [g[2] for g in got] == [True, True, True, False, False, False]
    assert language_id.score(odd.where("false"), models).collect() == []
    none = language_id.fit(train.where("false"))
    assert none == [] and {r.lang_pred for r in language_id.score(odd, none).collect()} == {"und"}


def test_sums_and_slices_of_rows():
    assert common.sums_by_row(np.array([1, 2, 3]), np.array([0, 2, 0, 1])).tolist() == [0, 3, 0, 3]
    assert list(common.slices(["a" * 5, "b", "c" * 9, ""], 7)) == [(0, 1), (1, 2), (2, 4)] or list(common.slices(["a" * 5, "b", "c" * 9, ""], 7))[-1][1] == 4


def test_plain_words_with_line_ends_and_marks_skip_the_library():
    table = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Uno.\nDOS,  tres!!***\n\nnaïve.\nÉtude&&& it's x-y 12,5 don't.\n", "", "\n", "a\r\nb ÷2× <|endoftext|>\nc$%&'s"]
    words, counts = table.words(texts)
    assert len(words) == counts.sum() and counts.tolist() == [t.count(" ") + t.count("\n") + 1 for t in texts]
    at = table.find(words)
    ids = np.split(table.gather(at), np.cumsum(common.sums_by_row(table.lengths(at), counts))[:-1])
    assert [i.tolist() for i in ids] == [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    table._library = lambda keys: asked.extend(keys) or []
    table.find(table.words(["neues.\nWort..., zwei&&&\ndrei?!"])[0])
    assert asked == []


def test_a_word_with_marks_or_capitals_is_encoded_once(odd):
    table = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    asked, encode = [], table.encode
    table.encode = lambda keys: asked.extend(keys) or encode(keys)
    table.find(table.parts(["wort Wort, WORT. wort!!*** it's", "", "\n"])[0])
    assert sorted(asked) == ["", "!!***", "'s", ",", ".", "it", "wort"]
    marked = ["a<|endoftext|>B, c", "H\u0331. J\u030c! \u03a3\u03a3,", "x=\u0338 y<\u0338|z", "\u0130I\u0307, K\u212a.", "<|ENDOFTEXT|> A,b", "don't.you'LL!", "\u00fc, \u00df.\u00aa! 1,2 a1,b"]
    for texts in ([x or "" for _, x in rows_of(odd)], marked, *([m] for m in marked)):
        words, places, counts = table.parts(texts)
        assert len(places) == counts.sum() and len(counts) == len(texts)
        at = table.find(words)[places]
        ids = np.split(table.gather(at), np.cumsum(common.sums_by_row(table.lengths(at), counts))[:-1])
        assert [i.tolist() for i in ids] == [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_holds_one_steps_table():
    first = common.held("first", lambda: [1])
    assert common.held("first", lambda: [2]) is first
    assert common.held("second", lambda: [2]) == [2] and common.held("first", lambda: [3]) == [3]
    common.held()
    assert common.held("first", lambda: [4]) == [4]


def test_a_kept_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "ein kurzer Satz", "de"), (2, None, "de"), (3, "123", None)], "doc_id long, text string, lang string")
    models = language_id.fit(docs.where("doc_id = 1"))
    found = language_id.score(docs, models, keep=["text", "lang"])
    assert sorted((r["doc_id"], r["text"] or "", r["lang"] or "", r["lang_pred"]) for r in found.collect()) == [(1, "ein kurzer Satz", "de", "de"), (2, "", "de", "und"), (3, "123", "", "und")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "kept_text" not in plan[plan.index("MapInArrow") :].split("\n", 1)[1]
