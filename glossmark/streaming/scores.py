"""Scores that follow a stream of outputs: the same additive statistics, summed by a streaming aggregate.

All metrics here work row by row, so all of them follow a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.text import normalize_ws
from glossmark.operators import corpus
from glossmark.operators.evaluate import RUN, add_stats
from glossmark.operators.metrics.base import Metric


def running_sums(stream: DataFrame, refs: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Sums of statistics per run of a stream (sys_id, opt_id, sent_id, hyp), against a static table of references.

    Rows delivered twice count twice; deduplicate the stream with a watermark before if it may repeat them.
    """
    texts = stream.select(*RUN, F.col("sent_id").cast("bigint").alias("sent_id"), normalize_ws(F.coalesce("hyp", F.lit(""))).alias("hyp"))
    stats = add_stats(corpus.with_references(texts, refs), metrics)
    return stats.groupBy(*RUN).agg(F.count(F.lit(1)).alias("sentences"), *[s for m in metrics for s in m.sums()])


def windowed_sums(stream: DataFrame, refs: DataFrame, metrics: list[Metric], time: str = "loaded_at", width: str = "1 hour", late: str = "10 days") -> DataFrame:
    """As running_sums, per window of event time; rows later than the watermark are left out by Spark."""
    texts = stream.withWatermark(time, late).select(
        *RUN, F.col("sent_id").cast("bigint").alias("sent_id"), normalize_ws(F.coalesce("hyp", F.lit(""))).alias("hyp"), time
    )
    stats = add_stats(corpus.with_references(texts, refs), metrics)
    return stats.groupBy(F.window(time, width), *RUN).agg(F.count(F.lit(1)).alias("sentences"), *[s for m in metrics for s in m.sums()])
