"""n-best lists: scores of entries, their ranks by each metric, and the corpus scores of chosen entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmark.functions.text import normalize_ws, two_decimals
from glossmark.operators import corpus
from glossmark.operators.evaluate import add_stats
from glossmark.operators.metrics.base import Metric
from glossmark.operators.ranking import number_over_tasks, number_rows, parted, window_place


def entries(nbest: DataFrame) -> DataFrame:
    """Entries as delivered last: of those with the same sentence and rank the greatest id; null texts are empty."""
    known = nbest.where("sent_id IS NOT NULL AND orig_rank IS NOT NULL")
    best = F.max(F.struct("entry_id", "hyp", "feats", "total"))
    one = known.groupBy("sent_id", "orig_rank").agg(best.alias("b")).select("sent_id", "orig_rank", "b.*")
    return one.select(
        F.col("sent_id").cast("bigint").alias("sent_id"), "orig_rank", "entry_id", normalize_ws(F.coalesce("hyp", F.lit(""))).alias("hyp"), "feats", "total"
    )


def number_entries(lines: DataFrame, group: str = "sent_id", order: str = "line_id") -> DataFrame:
    """``orig_rank``: place of each line within its list, from 0, in the order of the lines."""
    return number_rows(lines, [group], [F.asc(order)], "orig_rank").withColumn("orig_rank", F.col("orig_rank").cast("int"))


def entry_stats(nbest: DataFrame, refs: DataFrame, metrics: list[Metric]) -> DataFrame:
    full = add_stats(corpus.with_references(entries(nbest), refs, long_lists=True), metrics)
    return full.select("sent_id", "orig_rank", "entry_id", "hyp", "feats", "total", *[c for m in metrics for c in m.stats])


def scored_entries(stats: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Statistics, scores and submetrics of every entry."""
    return stats.select("*", *[m.scored() for m in metrics], *[c for m in metrics for c in m.subscores()])


def _order(metrics: list[Metric], k: int) -> list[Column]:
    """Best first by metric k; ties as ranked by the metric before it, in the end by the decoder."""
    score = lambda m: F.round(F.col(m.name), 9)  # noise of the last digits is a tie
    keys = [score(m).desc() if m.bigger_better else score(m).asc() for m in reversed(metrics[: k + 1])]
    return [*keys, F.asc("orig_rank")]


def ranked_entries(scored: DataFrame, metrics: list[Metric]) -> DataFrame:
    """``<metric>_rank`` from 0, and the size of each list. Lists too long for a task are ranked over all tasks."""
    keys, names = ["sent_id", "orig_rank"], [f"{m.name}_rank" for m in metrics]
    small, large = parted(scored, ["sent_id"])
    places = [window_place(["sent_id"], _order(metrics, k)).alias(n) for k, n in enumerate(names)]
    ranked = small.select("*", *places, F.count(F.lit(1)).over(W.partitionBy("sent_id")).alias("entries"))
    if large is None:
        return ranked
    ranks = large.select(*keys, *[m.name for m in metrics])
    for k, n in enumerate(names):
        ranks = number_over_tasks(ranks, ["sent_id"], _order(metrics, k), n)
    sizes = F.broadcast(large.groupBy("sent_id").agg(F.count(F.lit(1)).alias("entries")))  # a row per long list
    return ranked.unionByName(large.join(ranks.select(*keys, *names), keys).join(sizes, "sent_id"))


def corpus_scores(ranked: DataFrame, metrics: list[Metric], compat: bool = False, subscores: bool = False) -> DataFrame:
    """(metric, kind, score): corpus score of the best entry of each list, of the worst, and of the decoder's first.

    With ``subscores`` also their submetrics, as text.

    With ``compat`` the decoder's first entry of a later metric is the best entry of the metric before it, as lists
    that are sorted again and again have it.
    """
    rows = []
    for k, m in enumerate(metrics):
        rank = F.col(f"{m.name}_rank")
        first = F.col(f"{metrics[k - 1].name}_rank") if compat and k else F.col("orig_rank")
        for kind, chosen in (("oracle", rank == 0), ("worst", rank == F.col("entries") - 1), ("topbest", first == 0)):
            rows.append((m, kind, chosen))
    # One pass: each (metric, kind) sums the statistics of its own entries.
    sums = [F.sum(F.when(chosen, F.col(c))).alias(f"{m.name}_{kind}_{c}") for m, kind, chosen in rows for c in m.stats]
    one = ranked.agg(*sums)
    out = None
    for m, kind, _ in rows:
        own = one.select(*[F.col(f"{m.name}_{kind}_{c}").alias(c) for c in m.stats])
        named = [F.concat(F.lit(f"{n}="), two_decimals(c)) for n, c in zip(m.submetrics, m.subscores())]
        more = [F.concat_ws("; ", *named).alias("submetrics")] if subscores else []
        row = own.select(F.lit(m.name).alias("metric"), F.lit(kind).alias("kind"), m.score().alias("score"), *more)
        out = row if out is None else out.unionByName(row)
    return out


def entry_lines(ranked: DataFrame, metrics: list[Metric], digits: int | None = None) -> DataFrame:
    """(sent_id, orig_rank, line): ranked entries as lines of text.

    ``id ||| text ||| features ||| total ||| origRank=… <metric>Rank=… ||| <metric>=… <submetric>=…``; scores have as
    many ``digits`` as are asked for, by default all.
    """
    number = lambda n: F.col(n).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.round(n, digits))
    named = lambda n: F.concat(F.lit(f"{n}="), F.when(F.col(n).isNull(), F.lit("NaN")).otherwise(number(n)))
    ranks = [F.concat(F.lit("origRank="), "orig_rank"), *[F.concat(F.lit(f"{m.name}Rank="), f"{m.name}_rank") for m in metrics]]
    scores = [named(m.name) for m in metrics] + [named(s) for m in metrics for s in m.submetrics]
    total = F.when(F.col("total").isNull(), F.lit("NaN")).otherwise(F.format_string("%.6f", F.col("total").cast("double")))
    fields = [F.col("sent_id").cast("string"), F.col("hyp"), F.coalesce("feats", F.lit("")), total, F.concat_ws(" ", *ranks), F.concat_ws(" ", *scores)]
    return ranked.select("sent_id", "orig_rank", F.concat_ws(" ||| ", *fields).alias("line"))
