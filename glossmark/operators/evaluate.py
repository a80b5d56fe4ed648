"""Sufficient statistics, scores of runs and sentences, and their summary over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmark.operators import corpus
from glossmark.operators.metrics import load
from glossmark.operators.metrics.base import Metric
from glossmark.operators.ranking import number_rows

RUN = ["sys_id", "opt_id"]


def add_stats(sentences: DataFrame, metrics: list[Metric]) -> DataFrame:
    for m in metrics:
        sentences = m.add_stats(sentences)
    return sentences


def suff_stats(hypotheses: DataFrame, refs: DataFrame, metrics: list[Metric] | str = "bleu length", keep_text: bool = False) -> DataFrame:
    """The additive statistics of every sentence. All later steps sum these; texts are not read again."""
    metrics = load(metrics)
    full = add_stats(corpus.sentences(hypotheses, refs), metrics)
    text = ["hyp", "refs"] if keep_text else []
    return full.select(*RUN, "sent_id", *text, *[c for m in metrics for c in m.stats])


def _all_sums(metrics: list[Metric]) -> list[Column]:
    return [s for m in metrics for s in m.sums()]


def scores_by(stats: DataFrame, keys: list[str], metrics: list[Metric], subscores: bool = False) -> DataFrame:
    """Scores of sums: one wide row per key."""
    summed = stats.groupBy(*keys).agg(*_all_sums(metrics))
    more = [c for m in metrics for c in m.subscores()] if subscores else []
    return summed.select(*keys, *[m.scored() for m in metrics], *more)


def long_scores(scores: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(m.name).alias("score")) for m in metrics])
    return scores.select(*keys, F.inline(pairs))


def scores_by_run(stats: DataFrame, metrics: list[Metric]) -> DataFrame:
    return long_scores(scores_by(stats, RUN, metrics), RUN, metrics)


def pooled_scores(stats: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Scores of each system over the sums of all its runs."""
    return long_scores(scores_by(stats, ["sys_id"], metrics), ["sys_id"], metrics)


def sentence_scores(stats: DataFrame, metrics: list[Metric], subscores: bool = False) -> DataFrame:
    keep = [c for c in (*RUN, "sent_id", "hyp", "refs") if c in stats.columns]
    more = [c for m in metrics for c in m.subscores()] if subscores else []
    return stats.select(*keep, *[m.scored() for m in metrics], *more)


def run_summary(by_run: DataFrame) -> DataFrame:
    """Mean, sample deviation, least and greatest score over the runs of each system."""
    return by_run.groupBy("metric", "sys_id").agg(
        F.avg("score").alias("avg"), F.stddev_samp("score").alias("stddev"), F.min("score").alias("min"), F.max("score").alias("max")
    )


def median_runs(by_run: DataFrame) -> DataFrame:
    """(metric, sys_id, opt_id, score): the run at the upper median; of runs with that score, the first."""
    own = W.partitionBy("metric", "sys_id")
    ranked = by_run.withColumn("k", F.row_number().over(own.orderBy("score", "opt_id"))).withColumn("n", F.count(F.lit(1)).over(own))
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("score"))).over(own)
    at = ranked.withColumn("median", middle).where(F.col("score") == F.col("median"))
    return at.groupBy("metric", "sys_id", "score").agg(F.min("opt_id").alias("opt_id")).select("metric", "sys_id", "opt_id", "score")


def diff_rank(stats: DataFrame, metrics: list[Metric], by_run: DataFrame, baseline: int = 0) -> DataFrame:
    """Sentences of each system by what they gain over the baseline in a metric, each in its median run.

    ``place`` counts from 1, from the greatest gain in the raw score; ties by sentence. The other scores of both
    outputs stay, as ``<metric>`` and ``base_<metric>``.
    """
    kept, names = [c for c in ("hyp", "refs") if c in stats.columns], [m.name for m in metrics]
    at = median_runs(by_run).groupBy(*RUN).agg(F.collect_set("metric").alias("median_of"))
    # A row per system and metric at most; the rows of other runs end here.
    own = sentence_scores(stats, metrics).join(F.broadcast(at), RUN)
    median = long_scores(own, [*RUN, "sent_id", *kept, *names, "median_of"], metrics).where(F.array_contains("median_of", F.col("metric"))).drop("median_of")
    base = median.where(F.col("sys_id") == baseline).select(
        "metric", "sent_id", F.col("score").alias("base"), *[F.col(c).alias(f"base_{c}") for c in ("hyp", *names) if c in median.columns]
    )
    other = median.where(F.col("sys_id") != baseline)
    both = other.join(base, ["metric", "sent_id"]).withColumn("diff", F.col("score") - F.col("base"))
    gain = F.round("diff", 9).desc()  # noise of the last digits is a tie
    most = stats.groupBy(*RUN).count().agg(F.max("count")).first()[0] or 0  # a system has the rows of one run for each metric
    ranked = number_rows(both, ["metric", "sys_id"], [gain, F.col("sent_id").asc()], "place", most)
    return ranked.withColumn("place", F.col("place") + 1)


def results(by_run: DataFrame) -> DataFrame:
    """Everything known of the runs, in long form: (metric, sys_id, type, value)."""
    summary = run_summary(by_run)
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("value")) for t in ("avg", "stddev", "min", "max")])
    median = median_runs(by_run)
    both = F.array(
        F.struct(F.lit("median").alias("type"), F.col("score").alias("value")),
        F.struct(F.lit("median_idx").alias("type"), F.col("opt_id").cast("double").alias("value")),
    )
    return summary.select("metric", "sys_id", F.inline(kinds)).unionByName(median.select("metric", "sys_id", F.inline(both)))
