"""Planted passages, and alignment against a plain dynamic program."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmark.llm import leakage as K


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcde"), min_size=1, max_size=14))
def test_alignment(a, b):
    score, covered, steps, equal = K.align(a, b)
    assert score == plain_score(a, b) and equal <= covered <= steps


def traced(a, b):
    """Score, covered words, length and equal words by tracing back a whole table."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    top = max(map(max, h))
    end, j = next((i, j) for i, row in enumerate(h) for j, x in enumerate(row) if x == top)
    i, steps, equal = end, 0, 0
    while h[i][j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i][j] == h[i - 1][j - 1] + (1 if same else -1):
            i, j, equal = i - 1, j - 1, equal + same
        elif h[i][j] == h[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
        steps += 1
    return top, end - i, steps, equal


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=16))
def test_path(a, b):
    codes = [np.array([ord(c) for c in x]) for x in (a, b)]
    assert K.align(a, b) == traced(a, b) == K._row_by_row(*codes) == K._traced_back(*codes)


def test_repeats(spark):
    """A document of very many copies of a passage, in windows of bounded size; markup of any length."""
    rng = random.Random(4)
    words = [f"v{i}y" for i in range(900)]
    items = {i: [rng.choice(words) for _ in range(30)] for i in range(3)}
    filler = [f"f{i}z" for i in range(400)]
    docs = [
        (1, " ".join(items[0] * 20_000)),
        (2, " ".join(sum(([*items[1][5:20], *rng.sample(filler, 7)] for _ in range(3000)), []))),
        (3, " ".join(filler + items[2][:9] + filler) * 3),
        (4, " ".join(w + f'<a href="{"x" * 400}">' for w in items[2])),
    ]
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    block = K.Block(spark.createDataFrame([(0, items[0])], "item_id long, words array<string>").collect())
    import pyarrow as pa

    clusters = K.find_clusters(block, pa.array([1]), pa.array([docs[0][1].split()]))
    assert max(len(c[4]) for c in clusters) <= 120
    got = {(r.doc_id, r.item_id): (r.coverage, r.identity) for r in K.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), i).collect()}
    assert got == {(1, 0): (1.0, 1.0), (2, 1): (0.5, 1.0), (4, 2): (1.0, 1.0)}
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), i, coverage=0.25).collect()} == {(1, 0), (2, 1), (3, 2), (4, 2)}


def test_planted(spark):
    rng = random.Random(3)
    vocab = [f"w{i}x" for i in range(2000)]
    common = ["of", "the", "and", "to"]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]

    items = {i: text(40) for i in range(20)}
    docs, truth = [], set()
    for d in range(300):
        words = text(120)
        if d % 3 == 0:  # one passage in a third of the rows
            i = 0 if d % 2 == 0 else d % 20
            k = rng.randrange(0, 20)
            part = [rng.choice(vocab) if rng.random() < 0.08 else w for w in items[i][k : k + 20]]
            words[50:50] = [f"<b>{w.upper()}</b>," if n % 5 == 0 else w for n, w in enumerate(part)]
            truth.add((d, i))
        elif d % 3 == 1:  # short shared phrases, and the words of an item in another order
            words[30:30] = items[d % 20][5:10]
            words[90:90] = sorted(items[d % 20])
        docs.append((d, ("\n" if d % 2 else "  ").join(words), "x"))
    docs += [(900, None, ""), (901, "", ""), (902, "of the", ""), (0, docs[0][1], "again"), (903, "a " * 30_000, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(50, None), (51, "of the")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in K.find_leaks(d, i).collect()}
    assert got == truth
    assert K.find_leaks(d.limit(0), i).collect() == [] and K.find_leaks(d, i.limit(0)).collect() == []
