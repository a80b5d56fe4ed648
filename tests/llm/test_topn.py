"""Merged runs against sorting everything."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmark.llm import topn


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree(lists):
    runs = [sorted(x) for x in lists if x]
    if not runs:
        return
    at, out = [0] * len(runs), []
    tree = topn.LoserTree([(r[0],) for r in runs])
    while (key := tree.keys[w := tree.winner]) is not None:
        out.append(key[0])
        at[w] += 1
        tree.replay(w, (runs[w][at[w]],) if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)


def brute(rows, n, bigger):
    groups = {}
    for g, s, t in rows:
        if g is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s if bigger else s, t is None, t or 0))
    return sorted(((g, None if x[1] else x[2]) for g, v in groups.items() for x in sorted(v)[:n]), key=str)


def test_top(spark, monkeypatch):
    monkeypatch.setattr(topn, "BATCH", 16)
    monkeypatch.setattr(topn, "ROW_GROUP", 1024)
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, *range(60)]), rng.choice([0.0, -0.0, 1.5, 2.5, float("nan"), None, float("inf"), -3.0]), rng.choice([None, *range(50)])) for _ in range(4000)]
    rows += [(None, 1.0, 1), (100, 1.0, None), (100, 1.0, None), (101, None, 3)]
    df = spark.createDataFrame(rows, "g int, s double, t int").withColumn("k0", F.lit("clash")).withColumn("bucket", F.lit(1))
    for n, bigger in ((5, True), (1, False), (300, True)):
        got = topn.top_n(df, ["g"], F.col("s"), ["t"], n, bigger, buckets=3, runs=4).collect()
        assert sorted(((r.g, r.t) for r in got), key=str) == brute(rows, n, bigger)
    assert topn.top_n(df.limit(0), ["g"], F.col("s"), ["t"], 3).collect() == []


def test_entries(spark):
    rows = [(i, i % 3, i, float(-i), [1.0 * (i % 2), None, float("nan") if i == 5 else float(i)]) for i in range(30)] + [(99, None, 0, 1.0, None), (98, 0, 0, None, None)]
    n = spark.createDataFrame(rows, "entry_id long, sent_id int, orig_rank int, total float, metric_scores array<double>")
    got = {}
    for r in topn.best_entries(n, 2).collect():
        got.setdefault((r.criterion, r.sent_id), []).append(r.entry_id)
    assert got == {
        ("total", 0): [0, 3], ("total", 1): [1, 4], ("total", 2): [2, 5], ("bleu", 0): [3, 9], ("bleu", 1): [1, 7], ("bleu", 2): [5, 11],
        ("ter", 0): [0, 3], ("ter", 1): [1, 4], ("ter", 2): [2, 8],
    }
