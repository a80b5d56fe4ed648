"""Encoding against the library that reads the same vocabulary."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmark.llm import tokenise

pytestmark = pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def oracle():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenise.VOCABULARY)
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    flat, counts = tokenise.encode_texts(tokenise.merges(tokenise.VOCABULARY), texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


CASES = [
    "", None, " ", "  \n\n x", "hello world's 123,456 <|endoftext|>", "の の 痕瘢嘆 ジブモヤヘ。 これは", "aaaaaaaaaaaaaaaaaaaaa" * 50,
    "x" * 70_000, "naïve ﬁ ​­\u0085\x1c\x1d a\x00b\tc\r\n d", "Στη με ώνθώς βυφώνρής", "🎉👩‍👩‍👧 ok",
]


def test_cases(oracle):
    want = [oracle.encode(t, add_special_tokens=False).ids if t else [] for t in CASES]
    assert ids_of(CASES) == want


def test_every_character(oracle):
    texts = ["".join(f"a{chr(c)}b {chr(c)}" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x11000, 256)]
    want = [oracle.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i for i, (a, b) in enumerate(zip(ids_of(texts), want)) if a != b] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("ab ", max_size=200)), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenise.VOCABULARY)
    t.encode_special_tokens = True
    assert ids_of(texts) == [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def test_table(spark):
    rows = [(1, "a b", "x"), (None, None, "y"), (3, "", "z"), (1, "a b", "x")]
    got = tokenise.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 0), (1, 2), (1, 2), (3, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenise.encode_documents(empty).collect() == []
