"""The digest columns of the registered queries against hashes made in plain Python."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from centrum.llm import personal_data, queries, secret_scan


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_piece_digests(spark, folder, docs):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(ids := p.encode(t)), sha(",".join(map(str, ids))), sha(p.decode(ids) if ids else "")) for i, t in docs.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7(spark, folder).collect()} == want


def test_bpe_digests(spark, folder, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12(spark, folder).collect()} == want


def test_token_limits(spark, folder, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5(spark, folder).collect()} == want


@pytest.mark.parametrize("name,scan,base", [("op2_secret_scan", secret_scan.scan, ["assign", "access", "hex"]), ("op9_personal_data", personal_data.scan, ["email", "ip", "card", "phone"])])
def test_span_digests(spark, folder, docs, name, scan, base):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert rows.keys() == docs.keys()
    for r in rows.values():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        own = [s for s in spans if s[0] in base]
        assert r.base_sha256 == sha(",".join(":".join(s) for s in own))
        assert [getattr(r, f"n_{k}") for k in base] == [sum(s[0] == k for s in own) for k in base]
        assert [(int(s[1]), base.index(s[0])) for s in own] == sorted((int(s[1]), base.index(s[0])) for s in own)
        assert all(0 <= int(a) < int(b) <= len(docs[r.doc_id]) for _, a, b in spans)
