"""Whole evaluations in one call, as the command line runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.operators import evaluate as ev
from glossmark.operators import nbest as nb
from glossmark.operators import resample
from glossmark.operators.metrics import load
from glossmark.operators.metrics.base import Metric
from glossmark.session import hold


def results(stats: DataFrame, metrics: list[Metric], boot_samples: int = 10_000, ar_shuffles: int = 10_000, seed: int = 0) -> DataFrame:
    """(metric, sys_id, type, value): summary of runs, of replicas, and p-values against system 0.

    ``stats`` is read several times; persist it before.
    """
    out = ev.results(ev.scores_by_run(stats, metrics))
    if boot_samples:
        sums = resample.bootstrap_sums(stats, metrics, boot_samples, seed)
        boot = resample.bootstrap_summary(resample.replica_scores(sums, metrics))
        kinds = [c for c in boot.columns if c.startswith("resampled")]
        pairs = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("value")) for k in kinds])
        out = out.unionByName(boot.select("metric", "sys_id", F.inline(pairs)))
    if ar_shuffles:
        p = resample.p_values(resample.shuffle_sums(stats, metrics, ar_shuffles, seed), metrics)
        out = out.unionByName(p.select("metric", "sys_id", F.lit("p").alias("type"), F.col("p").alias("value")))
    return out


def evaluate(
    hypotheses: DataFrame, refs: DataFrame, metrics: str | list[Metric] = "bleu meteor ter length", boot_samples: int = 10_000, ar_shuffles: int = 10_000, seed: int = 0
) -> DataFrame:
    own = load(metrics)
    return results(hold(ev.suff_stats(hypotheses, refs, own)), own, boot_samples, ar_shuffles, seed)


def nbest(entries: DataFrame, refs: DataFrame, metrics: str | list[Metric] = "bleu meteor ter", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranked entries, and the corpus scores of the best, worst and first entry of each list."""
    own = load(metrics)
    scored = hold(nb.scored_entries(nb.entry_stats(entries, refs, own), own))
    ranked = hold(nb.ranked_entries(scored, own))
    return ranked, nb.corpus_scores(ranked, own, compat, subscores=True)
