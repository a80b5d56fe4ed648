"""Runs, resampling, n-best lists, sources, reports and streams."""

import random

import pytest
from pyspark.sql import functions as F

from glossmark.functions import numeric
from glossmark.operators import analysis, corpus, evaluate, nbest, report, resample
from glossmark.operators.metrics import load
from glossmark.sources import text as source
from glossmark.streaming import scores as stream_scores

M = load("bleu length")


@pytest.fixture(scope="module")
def stats(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    refs = [(s, 0, text(rng.randint(4, 12))) for s in range(60)]
    noisy = lambda t: " ".join(w for w in t.split() if rng.random() < 0.8) or "x"
    hyps = [(y, o, s, noisy(refs[s][2])) for y in (0, 1) for o in range(3) for s in range(60)]
    hyps += [(2, o, s, h) for y, o, s, h in hyps if y == 0]
    h = spark.createDataFrame(hyps, "sys_id int, opt_id int, sent_id long, hyp string")
    r = spark.createDataFrame(refs, "sent_id long, ref_id int, ref string")
    corpus.check_complete(h, r)
    return evaluate.suff_stats(h, r, M, keep_text=True).persist()


def test_median_run(spark):
    rows = [("bleu", 0, o, s) for o, s in enumerate([3.0, 1.0, 2.0, 2.0])] + [("bleu", 1, 0, 5.0)]
    by_run = spark.createDataFrame(rows, "metric string, sys_id int, opt_id int, score double")
    got = {r.sys_id: (r.opt_id, r.score) for r in evaluate.median_runs(by_run).collect()}
    assert got == {0: (2, 2.0), 1: (0, 5.0)}
    assert {r.sys_id: r.stddev for r in evaluate.run_summary(by_run).collect()}[1] is None


def test_equal_systems(stats):
    p = {(r.metric, r.sys_id): (r.diff, r.p) for r in resample.p_values(resample.shuffle_sums(stats, M, 50), M).collect()}
    assert p["bleu", 2] == (0.0, 1 / 51) and p["length", 2] == (0.0, 1 / 51)
    assert 0 < p["bleu", 1][1] <= 1


def test_shuffles_keep_sums(stats):
    """With the same permutation on both sides, the two sides always share out what the systems have."""
    sums = resample.shuffle_sums(stats, M, 20, partition=True).groupBy("sys_id", "shuffle").agg(F.sum("length_hyp").alias("n"))
    assert all(len({r.n for r in sums.where(F.col("sys_id") == s).collect()}) == 1 for s in (1, 2))
    a, b = (sorted(map(tuple, resample.shuffle_sums(stats.repartition(k), M, 5, seed=3).collect())) for k in (1, 6))
    assert a == b


def test_draws_of_chunks(spark, monkeypatch):
    """Sums of replicas are distributed alike over one chunk and over very many."""
    rows = [(0, 0, s, s % 7, 1) for s in range(500)]
    one = spark.createDataFrame(rows, "sys_id int, opt_id int, sent_id long, length_hyp long, length_ref long")
    length, got = load("length"), []
    for size in (1000, 1):
        monkeypatch.setattr(resample, "CHUNK", size)
        sums = resample.bootstrap_sums(one, length, 1500).toPandas()
        assert (sums["length_ref"] == 500).all() and len(sums) == 1500
        got.append(sums["length_hyp"])
    values = [r[3] for r in rows]
    mean, var = sum(values), sum((v - sum(values) / 500) ** 2 for v in values)
    for g in got:
        assert abs(g.mean() - mean) < 4 * (var / 1500) ** 0.5 and abs(g.var() / var - 1) < 0.15
        assert abs(((g - g.mean()) ** 3).mean()) < 0.3 * var**1.5


def test_long_lists(spark, monkeypatch):
    """Lists that are ranked over tasks have the ranks that windows give them."""
    from glossmark.operators import ranking

    rng = random.Random(9)
    rows = [(i, 0 if i % 3 == 0 else i % 9, i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), 0.0, "") for i in range(300)]
    n = spark.createDataFrame(rows, "entry_id long, sent_id int, orig_rank int, hyp string, total float, feats string")
    refs = spark.createDataFrame([(s, 0, "a b c a") for s in range(9)], "sent_id long, ref_id int, ref string")
    scored = nbest.scored_entries(nbest.entry_stats(n, refs, M), M).persist()
    short = sorted(map(str, nbest.ranked_entries(scored, M).collect()))
    monkeypatch.setattr(ranking, "WINDOW", 30)
    assert sorted(map(str, nbest.ranked_entries(scored, M).collect())) == short


def test_bootstrap(stats, monkeypatch):
    one = resample.bootstrap_sums(stats, M, 300).persist()
    monkeypatch.setattr(resample, "CHUNK", 7)
    many = resample.bootstrap_sums(stats, M, 300).persist()
    assert one.count() == many.count() == 9 * 300
    for sums in (one, many):
        r = {x.sys_id: x for x in resample.bootstrap_summary(resample.replica_scores(sums, M)).where("metric = 'length'").collect()}
        real = {x.sys_id: x.avg for x in evaluate.run_summary(evaluate.scores_by_run(stats, M)).where("metric = 'length'").collect()}
        assert all(abs(r[s].resampled_mean_avg - real[s]) < 1.0 and 0.5 < r[s].resampled_stddev_avg < 5 for s in real)
    again = resample.bootstrap_sums(stats.repartition(5), M, 300)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, many.collect()))


def test_diff_rank(stats):
    ranked = evaluate.diff_rank(stats, M, evaluate.scores_by_run(stats, M)).where("metric = 'length' AND sys_id = 1").orderBy("place").collect()
    assert [r.place for r in ranked] == list(range(1, 61))
    assert all(a.diff > b.diff - 1e-8 for a, b in zip(ranked, ranked[1:]))
    blocks = analysis.diff_blocks(evaluate.diff_rank(stats, M, evaluate.scores_by_run(stats, M)), M)
    own = blocks.where("file = 'sys2.sortedby.bleu'").orderBy("place").collect()
    assert len(own) == 60
    lines = own[0].block.split("\n")
    assert [x.split(":")[0] for x in lines[1:]] == ["bleu-median-baseline", "bleu-median-variant", "ref1", ""]
    assert lines[0].startswith(f"SENT {own[0].sent_id}\tbleu: ") and lines[0].split("\t")[2].startswith("length: ")


def test_nbest(spark):
    rows = [(1, 0, 0, "a b", 1.0), (2, 0, 1, "a b c", 2.0), (3, 0, 2, "a b c", 0.5), (4, 1, 0, None, 0.1), (5, None, 0, "x", 0.0), (9, 0, 1, "x y z", 9.0)]
    n = spark.createDataFrame(rows, "entry_id long, sent_id int, orig_rank int, hyp string, total float").withColumn("feats", F.lit("f=1"))
    refs = spark.createDataFrame([(0, 0, "a b c"), (1, 0, "q")], "sent_id long, ref_id int, ref string")
    scored = nbest.scored_entries(nbest.entry_stats(n, refs, M), M)
    got = {(r.sent_id, r.orig_rank): (r.bleu_rank, r.length_rank) for r in nbest.ranked_entries(scored, M).collect()}
    assert got == {(0, 0): (1, 2), (0, 1): (2, 1), (0, 2): (0, 0), (1, 0): (0, 0)}
    ranked = nbest.ranked_entries(scored, M)
    right = {(r.metric, r.kind): r.score for r in nbest.corpus_scores(ranked, M).collect()}
    assert right["length", "topbest"] == pytest.approx(75.0) and right["length", "oracle"] == pytest.approx(100.0)
    compat = {(r.metric, r.kind): r.score for r in nbest.corpus_scores(ranked, M, compat=True).collect()}
    assert compat["length", "topbest"] == pytest.approx(100.0)
    line = nbest.entry_lines(ranked, M).where("sent_id = 0 AND orig_rank = 0").first().line
    assert line.startswith("0 ||| a b ||| f=1 ||| 1.000000 ||| origRank=0 bleuRank=1 lengthRank=2 ||| bleu=")
    subs = nbest.corpus_scores(ranked, M, subscores=True).where("metric = 'bleu' AND kind = 'oracle'").first()
    assert subs.submetrics.startswith("bleu1p=") and subs.submetrics.endswith("; brevity=1.00")


def test_files(spark, tmp_path):
    for name, lines in {"h0": ["a  b ", "c\td", ""], "h1": ["a b", "x", "y"], "r0": ["a b", "c d", "e"], "short": ["a"]}.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    path = lambda n: str(tmp_path / n)
    h = source.read_hypotheses(spark, [[path("h0")], [path("h1")]])
    assert [tuple(r) for r in h.where("sys_id = 0").orderBy("sent_id").collect()] == [(0, 0, 0, "a b"), (0, 0, 1, "c d"), (0, 0, 2, "")]
    assert source.read_refs(spark, [path("r0")]).count() == 3
    with pytest.raises(ValueError):
        source.read_refs(spark, [path("r0"), path("short")])
    with pytest.raises(ValueError):
        source.read_hypotheses(spark, [[path("h0")], [path("h1"), path("h1")]])
    (tmp_path / "n").write_text('0 ||| a ||| f=1 ||| -1\n0 ||| " b , " he said . ||| f=2 ||| -2 ||| more\n1 ||| c |||  ||| 3\n')
    assert [tuple(r) for r in source.read_nbest(spark, path("n")).orderBy("sent_id", "orig_rank").select("sent_id", "orig_rank", "hyp", "feats", "total").collect()] == [
        (0, 0, "a", "f=1", -1.0), (0, 1, '" b , " he said .', "f=2", -2.0), (1, 0, "c", "", 3.0),
    ]
    for wrong in ("0 ||| a ||| f=1", "x ||| a ||| f ||| 1", "0 ||| a ||| f ||| one", "99999999999 ||| a ||| f ||| 1"):
        (tmp_path / "w").write_text(f"0 ||| a ||| f ||| 1\n{wrong}\n")
        with pytest.raises(Exception, match="n-best line"):
            source.read_nbest(spark, path("w")).collect()
    with pytest.raises(ValueError, match="no reference"):
        corpus.check_complete(h, source.read_refs(spark, [path("short")]))
    with pytest.raises(ValueError, match="references of 1"):
        corpus.check_lists(source.read_nbest(spark, path("n")), source.read_refs(spark, [path("short")]))
    lines = analysis.sentence_lines(evaluate.sentence_scores(evaluate.suff_stats(h, source.read_refs(spark, [path("r0")]), M, True), M, True), M)
    report.write_lines(lines, path("out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["file=sys1.opt1", "file=sys2.opt1"]


def test_split_file_numbers(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = source.numbered_lines(spark, str(tmp_path / "big"))
        assert rows.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("line")).count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables(spark):
    rows = [("bleu", s, t, v) for s in (0, 1) for t, v in (("avg", 18.25), ("stddev", 0.1), ("resampled_stddev_avg", 0.26), ("p", 0.0003))]
    long = spark.createDataFrame(rows, "metric string, sys_id int, type string, value double")
    lines = [r.line for r in report.ascii_table(long, load("bleu"), 3).orderBy("line_no").collect()]
    assert lines[0].startswith("n=3            BLEU (s_sel/s_opt/p)") and lines[1] == "baseline".ljust(15) + "18.3 (0.3/0.1/-)".ljust(23)
    assert "18.3 (0.3/0.1/0.00)" in lines[2]
    single = [r.line for r in report.ascii_table(long, load("bleu"), 1).orderBy("line_no").collect()]
    assert "18.3 (0.3/*/**)" in single[2] and len(single) == 5
    alone = report.ascii_table(long.where("sys_id = 0"), load("bleu"), 1, {0: "a name that is longer than its column"}).orderBy("line_no").collect()
    assert len(alone) == 3 and alone[1].line.startswith("a name that is longer than its column18.3")
    runs = spark.createDataFrame([("bleu", 0, 1, 12.5)], "metric string, sys_id int, opt_id int, score double")
    assert report.run_lines(runs).first().line == "RESULT: 0: BLEU: OptRun 1: 12.500000"
    eighth = spark.createDataFrame([("bleu", 1, "p", 0.125), ("bleu", 0, "avg", 0.25)], "metric string, sys_id int, type string, value double")
    assert "& 0.13 " in report.latex_table(eighth, load("bleu"), 3) and "& 0.3 " in report.latex_table(eighth, load("bleu"), 3)
    latex = report.latex_table(long, load("bleu"), 3, full_document=True)
    assert r"\multirow{2}{*}{BLEU $\uparrow$}" in latex and latex.startswith(r"\documentclass")
    assert "RESULT: 1: BLEU: P: 0.000300" in [r.line for r in report.result_lines(long).collect()]


def test_numeric(spark):
    row = spark.range(1).select(
        numeric.erf(F.lit(0.5)).alias("erf"), numeric.factorial_double(F.lit(5)).alias("f"), numeric.gamma_int(F.lit(5)).alias("g"),
        numeric.index_of(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.0)).alias("i"), numeric.add_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("s"),
    ).first()
    assert row.erf == pytest.approx(0.5204998778, abs=2e-7) and (row.f, row.g, row.i, row.s) == (120.0, 24.0, 1, [4, 6])


def test_stream(spark, tmp_path):
    rows = [(0, 0, s, f"a b {s}") for s in range(6)]
    schema = "sys_id int, opt_id int, sent_id long, hyp string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    refs = spark.createDataFrame([(s, 0, f"a b {s}") for s in range(6)], "sent_id long, ref_id int, ref string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_scores.running_sums(stream, refs, load("bleu length ter")).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("sums").first()
    assert row.sentences == 6 and row.bleu_match1 == 18 and row.length_ref == 18 and (row.ter_edits, row.ter_words) == (0, 18)


def test_command_line(spark, tmp_path, capsys):
    from glossmark.__main__ import main

    texts = {"b0": ["a b c d e", "x y"], "b1": ["a b c d", "x y z"], "s0": ["a b c d e f", "x"], "s1": ["a c d e", "y x"], "r0": ["a b c d e", "x y z"], "b2": ["a", "b", "c"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    p = lambda *names: [str(tmp_path / n) for n in names]
    base = ["eval", "--metrics", "bleu", "ter", "--refs", *p("r0"), "--boot-samples", "20", "--ar-shuffles", "20", "--latex", str(tmp_path / "t.tex")]
    lines = main([*base, "--sentLevelDir", str(tmp_path / "s"), "--rankDir", str(tmp_path / "k"), "--hyps-baseline", *p("b0", "b1"), "--hyps-sys1", *p("s0", "s1")])
    assert lines[0].startswith("n=2") and lines[1].startswith("baseline") and lines[2].startswith("system 1")
    assert (tmp_path / "t.tex").read_text().count("multirow") == 2
    assert sorted(x.name for x in (tmp_path / "k").iterdir() if x.is_dir()) == ["file=sys2.sortedby.bleu", "file=sys2.sortedby.ter"]
    with pytest.raises(SystemExit):
        main([*base, "--hyps-baseline", *p("b0"), "--nope"])
    (tmp_path / "n").write_text("0 ||| a b c ||| f=1 ||| -1\n0 ||| a b c d e ||| f=2 ||| -2\n1 ||| x y ||| f ||| 3\n")
    own = ["--metrics", "bleu", "ter", "--rankDir", str(tmp_path / "nk"), "--out", str(tmp_path / "no"), "--threads", "4", "--ter.beamWidth", "20"]
    got = main(["nbest", "--nbest", *p("n"), "--refs", *p("r0"), *own])
    assert len(got) == 6 and got[4] == "TER oracle score: 12.50 ()" and got[2].startswith("BLEU worst-oracle score: ")
    lines = sum((f.read_text().splitlines() for f in sorted((tmp_path / "no" / "file=nbest").glob("part*"))), [])
    assert [x.split(" ||| ")[1] for x in lines] == ["a b c", "a b c d e", "x y"]
    (tmp_path / "syn").write_text("big\tlarge\n")
    meteor = ["--metrics", "meteor", "--meteor.synonymDirectory", str(tmp_path / "syn"), "--meteor.task", "tune"]
    assert main(["nbest", "--nbest", *p("n"), "--refs", *p("r0"), *meteor])[1].startswith("METEOR oracle score: ")
    with pytest.raises(ValueError, match="no reference"):
        main([*base[:4], "--refs", *p("r0"), "--hyps-baseline", *p("b2")])


def test_own_metric(spark):
    from glossmark.operators.metrics import register
    from glossmark.operators.metrics.base import Metric

    class Vowels(Metric):
        name, label, stats, description = "vowels", "Vowels", ("vowels_n",), "share of a"

        def add_stats(self, sentences):
            return sentences.withColumn("vowels_n", F.size(F.filter("hyp_tokens", lambda t: t == "a")).cast("bigint"))

        def score(self):
            return F.col("vowels_n").cast("double")

    register("vowels", Vowels)
    h = spark.createDataFrame([(0, 0, 0, "a b a"), (0, 0, 1, "a")], "sys_id int, opt_id int, sent_id long, hyp string")
    r = spark.createDataFrame([(0, 0, "x"), (1, 0, "x")], "sent_id long, ref_id int, ref string")
    m = load("vowels")
    assert evaluate.scores_by_run(evaluate.suff_stats(h, r, m), m).first().score == 3.0


def test_numbers_over_tasks(spark, monkeypatch):
    """A group with a third of all rows, and small ones, over more tasks than groups."""
    from glossmark.operators import ranking
    from glossmark.operators.ranking import number_rows

    monkeypatch.setattr(ranking, "WINDOW", 700)  # the group with a third of all rows goes over tasks, the others do not
    rng = random.Random(8)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.randint(0, 50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, s int, id int")
    got = {r.id: r.k for r in number_rows(df, ["g"], [F.desc("s"), F.asc("id")], "k").collect()}
    want = {}
    for g in range(4):
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = k
    assert got == want
    assert number_rows(df.limit(0), ["g"], [F.asc("s")], "k").collect() == []


def test_queries_of_full_size(spark, tmp_path):
    """The registered queries draw 10,000 times: p against all swaps there are, and the resampled deviation."""
    from itertools import product

    from glossmark.plans import evaluation

    base, own, ref = [3, 5, 4, 6, 2, 7, 5, 4], [4, 5, 6, 7, 2, 9, 5, 3], 5
    hyps = [(s, 0, i, " ".join("w" * n), None) for s, sizes in enumerate((base, own)) for i, n in enumerate(sizes)]
    spark.createDataFrame(hyps, "sys_id int, opt_id int, sent_id long, hyp string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/hypotheses.parquet")
    refs = [(i, 0, " ".join("w" * ref), None) for i in range(len(base))]
    spark.createDataFrame(refs, "sent_id long, ref_id int, ref string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/refs.parquet")
    got = next(r for r in evaluation.ar_sampled(spark, str(tmp_path)).collect() if r.metric == "length")
    steps = [b - a for a, b in zip(base, own)]
    all_swaps = [abs(sum(d if x else -d for d, x in zip(steps, swap))) > abs(sum(steps)) for swap in product((0, 1), repeat=len(steps))]
    assert got.p == pytest.approx(sum(all_swaps) / len(all_swaps), abs=0.02)
    assert got.p * 10_001 == pytest.approx(round(got.p * 10_001), abs=0.01)
    boot = {r.sys_id: r for r in evaluation.bootstrap_sampled(spark, str(tmp_path)).collect() if r.metric == "length"}
    for sys_id, sizes in enumerate((base, own)):
        mean = sum(sizes) / len(sizes)
        exact = 100 / ref * (sum((x - mean) ** 2 for x in sizes) / len(sizes) / len(sizes)) ** 0.5
        assert boot[sys_id].resampled_stddev_avg == pytest.approx(exact, rel=0.04)
