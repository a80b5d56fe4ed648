"""Metrics against plain computations, and their properties."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmark.operators import evaluate
from glossmark.operators.metrics import load
from glossmark.operators.metrics.bleu import batch_stats
from glossmark.operators.metrics.meteor import Meteor, align, word_matches
from glossmark.operators.metrics.ter import Costs, Distance, Ter, edits

WORDS = st.lists(st.sampled_from(["a", "b", "c", "d", ""]), min_size=1, max_size=9)


def plain_bleu(hyp, refs):
    out = []
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: E731, B023
        clip = Counter()
        for r in refs:
            clip |= grams(r)
        out.append((max(len(hyp) - n + 1, 0), sum((grams(hyp) & clip).values())))
    length = min((abs(len(hyp) - len(r)), len(r)) for r in refs)[1]
    return [a for a, _ in out] + [m for _, m in out] + [length]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, st.lists(WORDS, min_size=1, max_size=3)), min_size=1, max_size=6))
def test_batch_of_bleu(rows):
    got = batch_stats(pa.array([h for h, _ in rows], type=pa.list_(pa.string())), pa.array([r for _, r in rows], type=pa.list_(pa.list_(pa.string()))))
    for i, (h, r) in enumerate(rows):
        assert [int(got[k][i]) for k in got if "att" in k] + [int(got[k][i]) for k in got if "match" in k] + [int(got["bleu_ref_len"][i])] == plain_bleu(h, r)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_distance_and_shifts(a, b):
    exact = plain_distance(a, b)
    assert Distance(b, Costs()).of(a) == exact
    assert edits(a, b) <= exact and edits(a, a) == 0
    assert (edits(a, b) == 0) == (a == b)
    assert edits(a, b, Costs(shift=100.0)) == exact


def test_one_shift():
    assert edits("a b c d e".split(), "d e a b c".split()) == 1
    assert Ter().sentence(["A", "b"], [["a", "b", "c"], ["a", "x"]]) == (1, 2)
    assert Ter(punctuation=False).sentence(["a", "b", "."], [["a", "b"]]) == (0, 2)
    assert Ter(shifts=False).sentence("a b c d e".split(), ["d e a b c".split()]) == (4, 5)
    block = [f"w{i}" for i in range(12)]
    assert edits([*block, "x", "y"], ["x", "y", *block], longest=None) == 1 and edits(["q", *block], [*block, "q"]) == 1
    assert edits([""], ["a"]) == 1 and Ter().sentence([""], [["a", "b"]]) == (2, 2)


def test_meteor():
    m = Meteor()
    words = str.split
    assert m.value(m.sentence(words("a b c"), [["x"], words("a b c")])[0]) == 1.0
    assert m.value(m.sentence([""], [["a"]])[0]) == 0.0
    assert [x[:3:2] for x in m.matches(["a", "b", "a"], ["a", "a", "b"])] == [(0, 1), (1, 2), (2, 0)]
    got, left_hyp, left_ref = m.sentence(words("the cats walked x x"), [words("the cat walks y")])
    assert got["meteor_hyp_content_exact"] == 1 and left_hyp == ["x", "x"] and left_ref == ["y"] and got["meteor_ref_content_stem"] == 2
    assert Meteor(synonyms={"big": ["large"]}).sentence(["Big"], [["large"]])[0]["meteor_hyp_content_synonym"] == 1
    p = Meteor(paraphrases={"in spite of": ["despite"]})
    got, left, _ = p.sentence(words("despite the rain"), [words("in spite of the rain")])
    assert (got["meteor_hyp_content_paraphrase"], got["meteor_ref_content_paraphrase"], got["meteor_chunks"], left) == (1, 3, 1, [])
    f = Meteor(function_words=["the", "of"])
    plain, weighed = f.sentence(words("the x of"), [words("the y of")])[0], f.sentence(words("x the"), [words("x of")])[0]
    assert plain["meteor_hyp_function_exact"] == 2 and f.value(weighed) > m.value(m.sentence(words("x the"), [words("x of")])[0])
    for wrong in ({"language": "xx"}, {"task": "nope"}, {"task": "adq"}, {"modules": ("exact", "guess")}):
        with pytest.raises(ValueError):
            Meteor(**wrong)
    with pytest.raises(ValueError):
        Meteor(modules=("exact",), weights=(1.0, 2.0))
    with pytest.raises(ValueError):
        load("bleu nope")


def all_alignments(options, used=frozenset(), i=0, size=0):
    if i == size:
        yield ()
        return
    for rest in all_alignments(options, used, i + 1, size):
        yield rest
    for j in options.get(i, ()):
        if j not in used:
            for rest in all_alignments(options, used | {j}, i + 1, size):
                yield ((i, j), *rest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
def test_alignment_is_best(hyp, ref):
    def cost(pairs):
        return -2 * len(pairs), sum(1 for x, y in zip([(-9, -9), *pairs], pairs) if (y[0] - x[0], y[1] - x[1]) != (1, 1)), sum(abs(i - j) for i, j in pairs)

    options = {i: [j for j, r in enumerate(ref) if r == h] for i, h in enumerate(hyp)}
    best = min(map(cost, all_alignments(options, size=len(hyp))))
    got = align(len(hyp), word_matches(hyp, ref, [lambda w: {w}]), beam=10_000)
    assert cost([(i, j) for i, _, j, _, _ in got]) == best


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    refs = [(s, r, text(rng.randint(1, 12)), None) for s in range(40) for r in range(rng.randint(1, 3))]
    hyps = [(y, o, s, refs[0][2] if s == 0 else text(rng.randint(1, 12)), None) for y in (0, 1) for o in range(3) for s in range(40)]
    hyps += [(2, o, s, h, None) for y, o, s, h, _ in hyps if y == 0]
    h = spark.createDataFrame(hyps, "sys_id int, opt_id int, sent_id long, hyp string, loaded_at timestamp_ntz")
    return h, spark.createDataFrame(refs, "sent_id long, ref_id int, ref string, loaded_at timestamp_ntz")


def test_equal_text_scores_full(spark):
    h = spark.createDataFrame([(0, 0, 0, "a b c d e")], "sys_id int, opt_id int, sent_id long, hyp string")
    r = spark.createDataFrame([(0, 0, "a b c d e")], "sent_id long, ref_id int, ref string")
    metrics = load("bleu length ter meteor")
    row = evaluate.scores_by_run(evaluate.suff_stats(h, r, metrics), metrics).collect()
    assert {x.metric: round(x.score, 9) for x in row} == {"bleu": 100.0, "length": 100.0, "ter": 0.0, "meteor": 100.0}


def test_smoothing_and_brevity(spark):
    """No 3-gram matches: its precision is half of one match, that of 4-grams a quarter."""
    h = spark.createDataFrame([(0, 0, 0, "a b x c d y"), (0, 0, 1, "")], "sys_id int, opt_id int, sent_id long, hyp string")
    r = spark.createDataFrame([(0, 0, "a b q c d w r t"), (1, 0, "")], "sent_id long, ref_id int, ref string")
    metrics = load("bleu")
    got = {x.sent_id: x for x in evaluate.sentence_scores(evaluate.suff_stats(h, r, metrics), metrics, subscores=True).collect()}
    logs = math.log(4 / 6) + math.log(2 / 5) + math.log(1 / (2 * 4)) + math.log(1 / (4 * 3))
    brevity = math.exp(1 - 8 / 6)
    assert got[0].bleu == pytest.approx(100 * brevity * math.exp(logs / 4)) and got[0].brevity == pytest.approx(brevity)
    assert got[1].bleu == pytest.approx(100.0)  # an empty text is one empty token


def test_order_of_sums(tables):
    h, r = tables
    m = load("bleu length")
    a = evaluate.scores_by_run(evaluate.suff_stats(h, r, m), m)
    b = evaluate.scores_by_run(evaluate.suff_stats(h.repartition(7, "hyp"), r.repartition(3), m).repartition(5), m)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_repeated_and_late_rows(spark, tables):
    h, r = tables
    m = load("bleu")
    again = h.unionByName(h).unionByName(h.selectExpr("sys_id", "opt_id", "sent_id", "CAST(NULL AS string) AS hyp", "loaded_at"))
    a, b = (sorted(map(tuple, evaluate.suff_stats(x, r.unionByName(r), m).collect())) for x in (h, again))
    assert a == b
    assert evaluate.suff_stats(h.limit(0), r, m).collect() == []
