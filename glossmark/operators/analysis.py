"""Reports on sentences: scores of each, gains and losses against the baseline, words that match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmark.functions.text import two_decimals
from glossmark.operators import corpus
from glossmark.operators.evaluate import median_runs
from glossmark.operators.metrics.base import Metric
from glossmark.operators.metrics.meteor import Meteor


def sentence_lines(scored: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Lines ``id ||| text ||| metric=… ||| submetric=…`` of each run; files are named by numbers from 1."""
    scores = F.concat_ws(" ", *[F.concat(F.lit(f"{m.name}="), two_decimals(F.col(m.name))) for m in metrics])
    subs = F.concat_ws(" ", *[F.concat(F.lit(f"{s}="), two_decimals(F.col(s))) for m in metrics for s in m.submetrics])
    file = F.format_string("sys%d.opt%d", F.col("sys_id") + 1, F.col("opt_id") + 1)
    return scored.select(
        "sys_id", "opt_id", "sent_id", file.alias("file"), F.concat_ws(" ||| ", F.col("sent_id").cast("string"), "hyp", scores, subs).alias("line")
    )


def diff_blocks(ranked: DataFrame, metrics: list[Metric]) -> DataFrame:
    """A block of text per sentence of a ranking (with texts), in order of ``place``.

    Scores, first those of the metric that it is ranked by, then both outputs and the references, each with its label.
    """

    def gain(m: Metric) -> Column:
        return F.format_string(f"{m.name}: %.1f -> %.1f = %.1f", F.col(f"base_{m.name}"), F.col(m.name), F.col(m.name) - F.col(f"base_{m.name}"))

    own = lambda m: F.col("metric") == m.name
    first = F.coalesce(*[F.when(own(m), gain(m)) for m in metrics])
    head = F.concat_ws("\t", F.format_string("SENT %d", "sent_id"), first, *[F.when(~own(m), gain(m)) for m in metrics])
    file = F.format_string("sys%d.sortedby.%s", F.col("sys_id") + 1, F.col("metric"))
    texts = [F.concat(F.col("metric"), F.lit(f"-median-{label}: "), F.col(c)) for label, c in (("baseline", "base_hyp"), ("variant", "hyp"))]
    refs = F.transform("refs", lambda r, i: F.concat(F.lit("ref"), i + 1, F.lit(": "), r))
    block = F.concat_ws("\n", head, *texts, refs, F.lit(""))
    return ranked.select("metric", "sys_id", "place", "sent_id", file.alias("file"), block.alias("block"))


def unmatched_words(hypotheses: DataFrame, refs: DataFrame, meteor: Meteor, by_run: DataFrame, top: int = 10) -> DataFrame:
    """(sys_id, side, word, n, place): the words most often left unmatched, in the median run of each system."""
    run = median_runs(by_run.where(F.col("metric") == "meteor")).select("sys_id", "opt_id")
    own = corpus.sentences(hypotheses, refs).join(F.broadcast(run), ["sys_id", "opt_id"])  # a row per system
    left = meteor.unmatched(own)
    words = None
    for side in ("hyp", "ref"):
        part = left.select("sys_id", F.lit(side).alias("side"), F.explode(f"left_{side}").alias("word"))
        words = part if words is None else words.unionByName(part)
    counted = words.groupBy("sys_id", "side", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("sys_id", "side").orderBy(F.desc("n"), "word"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def surface_unmatched(stats_text: DataFrame) -> DataFrame:
    """(sys_id, opt_id, word, n): words of outputs in excess of their greatest count in any reference of the sentence.

    The multiset difference, without an aligner. Needs hyp_tokens and ref_tokens.
    """
    keys = ["sys_id", "opt_id", "sent_id"]
    own = stats_text.select(*keys, F.explode("hyp_tokens").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("h"))
    one = stats_text.select("sent_id", "ref_tokens").dropDuplicates(["sent_id"])
    refs = one.select("sent_id", F.posexplode("ref_tokens").alias("r", "tokens")).select("sent_id", "r", F.explode("tokens").alias("word"))
    clip = refs.groupBy("sent_id", "r", "word").count().groupBy("sent_id", "word").agg(F.max("count").alias("c"))
    over = own.join(clip, ["sent_id", "word"], "left").withColumn("d", F.col("h") - F.coalesce("c", F.lit(0))).where("d > 0")
    return over.groupBy("sys_id", "opt_id", "word").agg(F.sum("d").alias("n"))
