"""Ids against the tokenizer library that reads the same vocabulary, and an exact way back."""

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import tokenizer as X

if not Path(X.FOLDER).exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)

own = X.Encoder(X.rank_file())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{X.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=1000, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "'s", "don't", "aaaa", "é", "字", "1234", "​", " "]), max_size=20).map("".join))
def test_round_trip(text):
    assert own.decode(own.encode(text)) == text and own.count(text) == len(own.encode(text))


def test_equals_library_on_documents(library, sf):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t] + ["<|endoftext|>", "a" * 5000, " " * 3000 + "x", "\n\n\n \t"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(own.encode(text)) == want.ids


def test_long_run_is_quick():
    assert own.decode(own.encode("ab" * 200_000)) == "ab" * 200_000


def test_frames(spark):
    rows = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in X.encoded(rows).collect()}
    assert got == {1: list(own.encode("hello world")), 2: [], 3: []}
    assert {r.doc_id: r.tokens for r in X.counted(rows, ["doc_id", "ids"]).collect()} == {1: 2, 2: 0, 3: 0}
    assert X.encoded(rows.where("doc_id > 9")).count() == 0
