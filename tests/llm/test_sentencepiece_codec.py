"""Encoding against the library, and round trips."""

import random

import pytest

from lithic.llm import sentencepiece_codec as C
from lithic.llm.queries import op7_sentencepiece

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=C.DEFAULT_MODEL)


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "   a", "a" + " " * 40 + "b ", "▁x ▁", "日本 漢字", "😀 e\u0301", "x" * 30_000, "don't", "a\0b", "\t\n", "　"]
    return texts + ["".join(rng.choice("abcdethé  \n.,▁日1😀") for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_encoding_equals_library(library):
    coder = C.Encoder(C.Vocabulary(C.DEFAULT_MODEL))
    texts = odd_texts()
    for ids, want, text in zip(coder.encode(texts), library.encode(texts), texts, strict=True):
        assert ids.tolist() == want, text
        if "▁" not in text:
            assert coder.decode(ids) == text


def test_forgetting_segments(library, monkeypatch):
    monkeypatch.setattr(C, "KEPT_SEGMENTS", 100)
    monkeypatch.setattr(C, "INDEX_SEGMENTS", 30)
    coder = C.Encoder(C.Vocabulary(C.DEFAULT_MODEL))
    texts = odd_texts()
    for a in range(0, 600, 50):
        assert [x.tolist() for x in coder.encode(texts[a : a + 50])] == library.encode(texts[a : a + 50])


def test_given_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_null_clashing_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "Hello  world", 4)], "doc_id long, text string, n_tokens int")
    rows = C.decode(C.encode(docs)).collect()
    assert sorted((r.doc_id, r.n_tokens > 0, r.decoded, r.round_trip) for r in rows) == [(1, False, "", True), (1, False, "", True), (2, True, "Hello  world", True)]
    assert C.encode(docs.limit(0)).count() == 0
