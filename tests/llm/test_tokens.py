"""Pieces, counts and ids against the tokenizers library itself."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventflow.llm import pieces
from eventflow.llm.pieces import Encoder, chunks
from eventflow.llm.token_counts import Counter, token_counts

from .samples import AWKWARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER, COUNTER = Encoder(PATH), Counter(PATH)
TEXTS = st.one_of(
    st.text(max_size=60),
    st.text(alphabet=" \n\tabcXYZ'stredé.,!?0129-_ß²½·", max_size=80),
    st.lists(st.sampled_from(["the", " of", "'re", "  ", "\n", "12", "!?", "né", "<|endoftext|>", " a", "\r\n"]), max_size=20).map("".join),
)


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(ENCODER([text])[0], ENCODER.dtype).tolist() == expected(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(text):
    assert COUNTER.text(text) == len(expected(text))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_chunks_end_where_pieces_do(text, size):
    parts = list(chunks(text, size))
    assert "".join(parts) == text
    if pieces.OUTSIDE.search(text) is None:
        assert [p for part in parts for p in pieces.PIECE.findall(part)] == pieces.PIECE.findall(text)


def test_full_memos_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 3)
    monkeypatch.setattr(pieces, "MEMO_PIECES", 3)
    small = Encoder(PATH)
    for text in ("one two three four five, six", "seven eight. nine ten", "one two ten!"):
        assert np.frombuffer(small([text])[0], small.dtype).tolist() == expected(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, "!" * 9_999, " " * 5_000 + "x"])
def test_one_long_piece(text):
    assert COUNTER.text(text) == len(expected(text))


def test_long_text_in_parts(monkeypatch):
    text = "Some words, and\nmore  words. " * 50
    monkeypatch.setattr(pieces.chunks, "__defaults__", (64,))
    assert np.frombuffer(Encoder(PATH)([text])[0], "<u2").tolist() == expected(text)


def test_counts_of_a_table(spark):
    rows = token_counts(docs(spark, AWKWARD), PATH, limit=512).collect()
    assert rows[0].__fields__ == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(expected(t or "")), len(expected(t or "")) > 512) for i, t in AWKWARD]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert token_counts(docs(spark, []), PATH, limit=5).count() == 0
