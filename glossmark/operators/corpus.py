"""Sentences: outputs of systems and runs, joined with their references.

Rows delivered again are resolved by the time they were loaded, the latest wins, then the text that is greatest; a
null output counts as an empty one. Sentences of tables that have no reference drop out, as nothing can be scored for
them; ``check_complete`` and ``check_lists`` raise if there are such, and whole evaluations of files call them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.text import normalize_ws, tokenize


def latest(df: DataFrame, keys: list[str], value: str, loaded: str = "loaded_at") -> DataFrame:
    """One row per key: the text loaded last. The maximum is merged before the shuffle, so repeated keys are cheap."""
    named = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    time = F.col(loaded) if loaded in df.columns else F.lit(None).cast("timestamp")
    best = F.max(F.struct(time.alias("t"), F.col(value).alias("v")))
    return named.groupBy(*keys).agg(best["v"].alias(value))


def outputs(hypotheses: DataFrame) -> DataFrame:
    """(sys_id, opt_id, sent_id, hyp), normalized."""
    one = latest(hypotheses, ["sys_id", "opt_id", "sent_id"], "hyp")
    return one.withColumn("hyp", normalize_ws(F.coalesce("hyp", F.lit(""))))


def references(refs: DataFrame) -> DataFrame:
    """(sent_id, refs): all references of a sentence in the order of their ids."""
    one = latest(refs, ["sent_id", "ref_id"], "ref").where("ref IS NOT NULL")
    pairs = F.array_sort(F.collect_list(F.struct("ref_id", normalize_ws(F.col("ref")).alias("ref"))))
    return one.groupBy("sent_id").agg(pairs["ref"].alias("refs"))


def python_tasks(df: DataFrame) -> int:
    """Tasks for work in Python: several per core, and no fewer than a shuffle has."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_references(texts: DataFrame, refs: DataFrame, long_lists: bool = False) -> DataFrame:
    """Texts with the arrays that the metrics need.

    A sentence has a text per run, so both sides are shuffled by sentence, once, into as many tasks as the metrics
    want. With ``long_lists`` a sentence may have any number of texts: the join is left to adaptive execution, which
    splits a hot sentence, and its texts are spread by what they say, equal ones to the same task.
    """
    own = references(refs)
    if texts.isStreaming:
        joined = texts.join(own, "sent_id")
    elif long_lists:
        joined = texts.join(own, "sent_id").repartition(python_tasks(texts), "sent_id", F.xxhash64("hyp"))
    else:
        tasks = python_tasks(texts)
        joined = texts.repartition(tasks, "sent_id").join(own.repartition(tasks, "sent_id"), "sent_id")
    return joined.withColumn("hyp_tokens", tokenize(F.col("hyp"))).withColumn("ref_tokens", F.transform("refs", tokenize))


def sentences(hypotheses: DataFrame, refs: DataFrame) -> DataFrame:
    return with_references(outputs(hypotheses), refs)


def check_complete(hypotheses: DataFrame, refs: DataFrame) -> None:
    """Raise unless all runs have the same sentences, all systems the same number of runs, and all sentences references."""
    out = outputs(hypotheses)
    runs = out.groupBy("sys_id", "opt_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("sent_id").cast("decimal(38,0)")).alias("h"))
    sizes = runs.agg(F.count_distinct("n", "h").alias("sizes")).first()["sizes"]
    if sizes and sizes > 1:
        raise ValueError("runs differ in their sentences")
    counts = runs.groupBy("sys_id").count().agg(F.count_distinct("count").alias("k")).first()["k"]
    if counts and counts > 1:
        raise ValueError("systems differ in their number of optimizer runs")
    if out.select("sent_id").join(references(refs), "sent_id", "left_anti").limit(1).count():
        raise ValueError("some sentences have no reference")


def check_lists(entries: DataFrame, refs: DataFrame) -> None:
    """Raise unless the references are those of the sentences 0 to the last that has a list."""
    last = entries.agg(F.max("sent_id")).first()[0]
    own = refs.agg(F.count_distinct("sent_id").alias("n"), F.max("sent_id").alias("last")).first()
    if last is not None and (own["n"], own["last"]) != (last + 1, last):
        raise ValueError(f"lists of {last + 1} sentences, but references of {own['n']}")


def counts(hypotheses: DataFrame, refs: DataFrame) -> DataFrame:
    """Number of sentences, references, runs and systems, in one row."""
    h = outputs(hypotheses).agg(
        F.count_distinct("sent_id").alias("sentences"), F.count_distinct("sys_id").alias("systems"), F.count_distinct("opt_id").alias("runs")
    )
    r = latest(refs, ["sent_id", "ref_id"], "ref").agg(F.count_distinct("ref_id").alias("references"))
    return h.crossJoin(r)  # one row with one row
