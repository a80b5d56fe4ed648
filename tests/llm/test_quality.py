"""Line labels, forward-backward against enumeration, and whole tables."""

import itertools
import random

import numpy as np

from glossmark.llm import quality as Q

COMMON = ["the", "of", "and", "to", "in", "is"]


def model(rng):
    counts = rng.random(Q.COUNTS) * 20
    return Q.Model.of(counts)


def test_forward_backward():
    rng = np.random.default_rng(1)
    m, k = model(rng), len(Q.STATES)
    lines = np.array([3, 1, 4, 2])
    bins = np.stack([rng.integers(0, n, lines.sum()) for n in Q.BINS.values()], axis=1)
    gamma, first, steps = Q.posteriors(m, bins, lines)
    e, at, want_first, want_steps = m.emission(bins), 0, np.zeros(k), np.zeros((k, k))
    for n in lines:
        weights, total = np.zeros((n, k)), 0.0
        s = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.exp(m.first[path[0]] + sum(m.step[a, b] for a, b in zip(path, path[1:])) + sum(e[at + t, x] for t, x in enumerate(path)))
            total += p
            for t, x in enumerate(path):
                weights[t, x] += p
            for a, b in zip(path, path[1:]):
                s[a, b] += p
        assert np.allclose(gamma[at : at + n], weights / total)
        want_first += weights[0] / total
        want_steps += s / total
        at += n
    assert np.allclose(first, want_first) and np.allclose(steps, want_steps)


def test_long_documents(monkeypatch):
    """Going through stretches gives what going line by line gives."""
    rng = np.random.default_rng(3)
    m = model(rng)
    lines = np.array([700, 3, 1, 257, 64, 65, 2])
    bins = np.stack([rng.integers(0, n, lines.sum()) for n in Q.BINS.values()], axis=1)
    plain = Q.posteriors(m, bins, lines)
    monkeypatch.setattr(Q, "LONG", 1)
    for a, b in zip(plain, Q.posteriors(m, bins, lines)):
        assert np.allclose(a, b)


def documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    prose = lambda: " ".join([word().title()] + [rng.choice(COMMON) if rng.random() < 0.4 else word() for _ in range(rng.randint(6, 14))]) + "."
    kinds = {
        "prose": lambda: [prose() for _ in range(rng.randint(1, 9))],
        "list": lambda: ["- " + word() for _ in range(rng.randint(5, 12))],
        "table": lambda: ["\t".join([word()] + [str(rng.randint(1, 9999)) for _ in range(4)]) for _ in range(rng.randint(4, 9))],
        "junk": lambda: ["".join(rng.choice("#@%$&*<>=~") for _ in range(60)) for _ in range(rng.randint(1, 5))],
    }
    return [(i, "\n".join(kinds[k]()), k) for i, k in enumerate(rng.choice(["prose"] * 3 + list(kinds)) for _ in range(400))]


def test_labels(spark, monkeypatch):
    rows = documents()
    odd = [(1000, None, ""), (1001, "", ""), (1002, " \n\t", ""), (1003, "x" * 200_000, ""), (None, rows[0][1], ""), (0, rows[0][1], "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, words string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    got = {r.doc_id: r for r in Q.text_figures(docs, common).collect()}
    wrong = [i for i, _, k in rows if (got[i].prose < 0.5) != (k != "prose")]
    assert len(wrong) <= 4
    assert got[1000].words == 0 and got[1001].prose is None and got[1002].mean_word_length is None and got[1003].prose < 0.5
    first = rows[0][1]
    assert got[0].ended_lines == sum(x[-1] == "." for x in first.split("\n")) / len(first.split("\n"))
    assert Q.text_figures(docs.limit(0), common).collect() == []
    assert Q.text_figures(docs.limit(1), common.limit(0)).count() == 1
    several = common.unionByName(spark.createDataFrame([("xx", w) for w in ("the", "ba")] + [("yy", "of"), (None, "in"), ("zz", None)], "lang string, word string"))
    want = {r.doc_id: r.common_words for r in Q.text_figures(docs, several).collect()}
    monkeypatch.setattr(Q, "COMMON_BLOCK", 3)
    assert len(Q._common_blocks(several)) == 3
    assert {r.doc_id: r.common_words for r in Q.text_figures(docs, several).collect()} == want
    assert abs(sum(got[0][s] for s in Q.LABELS) - 1) < 1e-9
    plain = Q.plain_figures(docs, common)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in Q.text_figures(docs, common).select(plain.columns).collect()}
    assert Q.plain_figures(docs.limit(0), common).collect() == []
