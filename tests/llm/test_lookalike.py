"""Spliced normalization against normalizing whole texts."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from glossmark.llm import lookalike as L

ODD = "aeiouAО еаѕԁ̧̣́̈​ 　ｅ５ﾞｶ가각é²ﬁⅣ한ᾴ­"


def whole(text):
    return re.sub(" +", " ", L.normal_form(text)).strip(" ")


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(ODD, max_size=40))
def test_splices_equal_whole(text):
    assert L.canonical(text) == whole(text)


def test_stable_under_repetition():
    for code in range(0x20, 0x3000):
        once = L.canonical(f"a{chr(code)}b")
        assert L.canonical(once) == once, hex(code)


def test_looks_the_same():
    same = [("ｃａｆé", "café"), ("con lárad", "con lárad"), ("e‌t", "et"), ("ѕеа", "sea"), ("ｶﾞ", "ガ"), (" a ", "a")]
    assert all(L.canonical(a) == L.canonical(b) for a, b in same)
    seen = [("a²", "a2"), ("e", "é"), ("A", "a"), ("0", "o"), ("1", "l"), ("3", "e"), ("n", "ñ")]
    assert all(L.canonical(a) != L.canonical(b) for a, b in seen)
    assert unicodedata.is_normalized("NFC", L.canonical("ẹ́"))


def test_table(spark):
    e = spark.createDataFrame(
        [(1, 7, "ｅt"), (2, 7, "et "), (3, 7, None), (4, None, "et"), (5, 7, ""), (6, 8, "et"), (7, 7, "x" * 50_000), (1, 7, "ｅt")],
        "entry_id long, sent_id int, hyp string",
    )
    r = spark.createDataFrame([(7, 0, "et"), (7, 0, "et"), (7, 1, "e​t"), (7, 2, None), (None, 3, "et")], "sent_id long, ref_id int, ref string")
    got = sorted(map(tuple, L.same_looking(e, r).collect()))
    assert got == [(7, 0, 1), (7, 1, 1), (7, 1, 2)]
    assert L.same_looking(e.limit(0), r).collect() == []
