import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from steploom.llm.bpe import VOCABULARY, Encoder, Merges, count_tokens, encode_text, merge_one


MERGES = Merges.read()
LIBRARY = Tokenizer.from_file(VOCABULARY)
LIBRARY.encode_special_tokens = True


@pytest.fixture
def merges():
    return MERGES


@pytest.fixture
def library():
    return LIBRARY


def same(merges, library, texts):
    got = Encoder(merges).lists(texts).to_pylist()
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


@given(st.lists(st.text(max_size=80), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    same(MERGES, LIBRARY, texts)


def test_wide_and_special(merges, library):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|> it's", "a" * 5000, "".join(rng.choice("abcdeö") for _ in range(3000)), "=" * 70, "ab" * 31 + "c", "你好世界" * 40]
    same(merges, library, texts)


def test_documents(spark, merges, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in encode_text(df, "text", ["doc_id"]).collect()}
    assert ids == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in rows.items()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "text", ["doc_id"]).collect()} == {k: len(v) for k, v in ids.items()}


def test_one_piece_tree(merges):
    for piece in (b"", b"x", b" the", "ö".encode() * 9, b"straightforwardness"):
        assert merge_one(merges, piece) == (Encoder(merges).lists([piece.decode()]).to_pylist()[0] if piece else [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_text(df, "text", ["doc_id"]).collect() == []
