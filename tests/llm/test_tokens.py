"""Encoding equals the library's, whatever is cut where."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def small():
    from tidemark.llm.tokens import Encoder, default_vocabulary

    return Encoder(default_vocabulary(), leaf=5)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcthein'sdm <|endoftext|>09!?\n", max_size=80))
def test_encoding_equals_the_library(library, small, text):
    ids = np.frombuffer(small.encode(text), dtype="<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert small.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_tree_of_a_long_unsplit_stretch(library):
    from tidemark.llm.tokens import Encoder, default_vocabulary

    rng = random.Random(4)
    for alphabet in ("ab", "theinandof", "é中ñ", "!?.-"):
        text = "".join(rng.choice(alphabet) for _ in range(20_000))
        enc = Encoder(default_vocabulary(), leaf=300)
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_in_spark(spark, library):
    from tidemark.llm.tokens import decode, encode

    rows = decode(encode(documents(spark, clashing=True), segment=50, leaf=20), text_col="decoded").collect()
    assert len(rows) == len(corpus())
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
