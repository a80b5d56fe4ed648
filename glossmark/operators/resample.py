"""Test-set variance by bootstrap, and p-values by stratified approximate randomization.

Both have two forms. The sampled form draws with numpy inside tasks and needs no copy of the statistics anywhere:
sentences are cut into chunks, every task draws for its chunk and sends partial sums of each replica, which Spark
adds. The hashed form draws by hashes of (seed, replica, row), in plain SQL, for small numbers of replicas that another
engine can repeat.

All sums are sums of integers, so equal systems have exactly equal scores.
"""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmark.operators.corpus import python_tasks
from glossmark.operators.evaluate import RUN, long_scores
from glossmark.operators.metrics.base import Metric
from glossmark.operators.ranking import number_rows

#: Sentences in a chunk, about; a task holds the statistics of one chunk. Small, so that few sentences keep many cores busy.
CHUNK = 1_000
#: Cells of random numbers that a task holds at a time.
CELLS = 4_000_000


def h32(text: Column) -> Column:
    """First 32 bits of an md5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _stat_names(metrics: list[Metric]) -> list[str]:
    return [c for m in metrics for c in m.stats]


def _chunks(sentences: int) -> int:
    return max(1, math.ceil(sentences / CHUNK))


def _chunked(stats: DataFrame, chunks: int) -> DataFrame:
    return stats.withColumn("chunk", F.pmod(F.xxhash64("sent_id"), F.lit(chunks)).cast("int"))


def _paths(cut: DataFrame, chunks: int) -> DataFrame:
    """(of_sys_id, of_opt_id, of_chunk, total, path): the way to each chunk through a binary tree over the chunks.

    At each step the path has the sentences under the node and under its left half. The tree is never in one place.
    """
    depth = (chunks - 1).bit_length()
    sizes = cut.groupBy(*RUN, "chunk").agg(F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(sizes.groupBy(*RUN).agg(F.sum("n").alias("total")))  # a row per run
    keys = [F.col(k).alias(f"of_{k}") for k in (*RUN, "chunk")]
    step = "struct<level: int, n: bigint, left: bigint>"
    if not depth:
        return sizes.join(totals, RUN).select(*keys, "total", F.array().cast(f"array<{step}>").alias("path"))
    up = lambda level: F.call_function("shiftright", "chunk", F.lit(depth) - level)
    levels = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    nodes = levels.groupBy(*RUN, "level", up(F.col("level")).alias("node")).agg(F.sum("n").alias("n"))
    halves = nodes.select(*RUN, (F.col("level") - 1).alias("level"), (F.col("node") / 2).cast("int").alias("node"), (F.col("node") % 2).alias("right"), F.col("n").alias("half"))
    splits = nodes.join(halves.where("right = 0"), [*RUN, "level", "node"], "left").select(*RUN, "level", "node", "n", F.coalesce("half", F.lit(0)).alias("left"))
    own = sizes.select(*RUN, "chunk", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")).withColumn("node", up(F.col("level")))
    path = own.join(splits, [*RUN, "level", "node"]).groupBy(*RUN, "chunk").agg(F.array_sort(F.collect_list(F.struct("level", "n", "left"))).alias("path"))
    return path.join(totals, RUN).select(*keys, "total", "path")


def bootstrap_sums(stats: DataFrame, metrics: list[Metric], replicas: int = 10_000, seed: int = 0) -> DataFrame:
    """(sys_id, opt_id, replica, summed statistics): N draws with replacement from the N sentences of each run.

    How many of a replica's draws fall into each chunk is a multinomial draw, made as binomial draws down a binary tree
    over the chunks: each node has a seed of its own, so all tasks below it draw alike there, and a task makes as many
    draws as the tree is deep. Within its chunk the draws are then its own. Replicas share their draws over metrics.
    """
    names = _stat_names(metrics)
    at_most = stats.groupBy(*RUN).count().agg(F.max("count")).first()[0] or 0
    chunks = _chunks(at_most)
    depth = (chunks - 1).bit_length()
    cut = _chunked(stats.select(*RUN, "sent_id", *names), chunks)

    def draw(key: tuple, pdf: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        sys_id, opt_id, chunk = (int(k) for k in key)
        draws_of = np.full(replicas, int(way["total"].iloc[0]))
        for step in way["path"].iloc[0]:
            level, n, left = (int(step[k]) for k in ("level", "n", "left"))
            rng = np.random.default_rng([seed, sys_id, opt_id, level, chunk >> (depth - level), 2])
            to_left = rng.binomial(draws_of, left / n)
            draws_of = draws_of - to_left if chunk >> (depth - level - 1) & 1 else to_left
        rng = np.random.default_rng([seed, sys_id, opt_id, chunk, 1])
        m = pdf.sort_values("sent_id")[names].to_numpy(dtype=np.int64)
        out = np.zeros((replicas, len(names)), dtype=np.int64)
        step = max(1, CELLS // max(1, 2 * len(m)))
        for a in range(0, replicas, step):
            b = min(replicas, a + step)
            draws = draws_of[a:b]
            places = rng.integers(0, len(m), size=int(draws.sum()))
            owner = np.repeat(np.arange(b - a), draws)
            times = np.bincount(owner * len(m) + places, minlength=(b - a) * len(m)).reshape(b - a, len(m))
            # Exact below 2**53, and much faster than an integer product.
            out[a:b] = (times.astype(np.float64) @ m.astype(np.float64)).astype(np.int64)
        return pd.DataFrame({"sys_id": sys_id, "opt_id": opt_id, "replica": np.arange(replicas), **{n: out[:, i] for i, n in enumerate(names)}})

    schema = "sys_id int, opt_id int, replica int, " + ", ".join(f"{n} bigint" for n in names)
    # A fixed number of tasks: few bytes of statistics give long work, and must not be merged into few tasks.
    keys, tasks = [*RUN, "chunk"], python_tasks(stats)
    own, ways = cut.repartition(tasks, *keys), _paths(cut, chunks).repartition(tasks, *[f"of_{k}" for k in keys])
    parts = own.groupBy(*keys).cogroup(ways.groupBy(*[f"of_{k}" for k in keys])).applyInPandas(draw, schema)
    return parts.groupBy(*RUN, "replica").agg(*[F.sum(n).alias(n) for n in names])


def hashed_bootstrap_sums(stats: DataFrame, metrics: list[Metric], replicas: int, seed: int = 0) -> DataFrame:
    """As bootstrap_sums, drawing sentence number ``h32(seed:replica:sys:opt:slot) % N`` for each slot."""
    names = _stat_names(metrics)
    sizes = F.broadcast(stats.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")))  # a row per run
    numbered = number_rows(stats, RUN, [F.asc("sent_id")], "row").join(sizes, RUN)
    slots = numbered.select(*RUN, F.col("row").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    drawn = slots.select(*RUN, "replica", (h32(F.concat_ws(":", F.lit(seed), "replica", *RUN, "slot")) % F.col("n")).alias("row"))
    return drawn.join(numbered, [*RUN, "row"]).groupBy(*RUN, "replica").agg(*[F.sum(n).alias(n) for n in names])


def replica_scores(sums: DataFrame, metrics: list[Metric]) -> DataFrame:
    keys = [*RUN, "replica"]
    return long_scores(sums.select(*keys, *[m.scored() for m in metrics]), keys, metrics)


def bootstrap_summary(scores: DataFrame) -> DataFrame:
    """Mean and deviation over replicas, averaged over the runs of each system; least and greatest of all."""
    run = scores.groupBy("metric", *RUN).agg(
        F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi")
    )
    return run.groupBy("metric", "sys_id").agg(
        F.avg("m").alias("resampled_mean_avg"), F.avg("s").alias("resampled_stddev_avg"), F.min("lo").alias("resampled_min"), F.max("hi").alias("resampled_max")
    )


def _pairs(stats: DataFrame, names: list[str], baseline: int) -> DataFrame:
    """Rows of every other system next to the baseline's of the same run and sentence."""
    a = stats.where(F.col("sys_id") == baseline).select("opt_id", "sent_id", *[F.col(n).alias(f"a_{n}") for n in names])
    b = stats.where(F.col("sys_id") != baseline).select("sys_id", "opt_id", "sent_id", *[F.col(n).alias(f"b_{n}") for n in names])
    return b.join(a, ["opt_id", "sent_id"])


def _weights(perm: np.ndarray, swap: np.ndarray, partition: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the other system at each source row: row i of a side takes the swapped or own system at row perm[i]."""
    back = perm if partition else np.argsort(perm, axis=-1)
    wx, wy = np.zeros(perm.shape), np.zeros(perm.shape)
    np.put_along_axis(wx, perm, swap.astype(float), axis=-1)
    np.put_along_axis(wy, back, 1.0 - swap, axis=-1)
    return wx, wy


def _patterns(runs: int, partition: bool) -> tuple[np.ndarray, np.ndarray]:
    """The weights of every permutation of few runs with every swap."""
    both = [(p, s) for p in permutations(range(runs)) for s in product((0, 1), repeat=runs)]
    return _weights(np.array([p for p, _ in both]), np.array([s for _, s in both]), partition)


def shuffle_sums(stats: DataFrame, metrics: list[Metric], shuffles: int = 10_000, seed: int = 0, baseline: int = 0, partition: bool = False) -> DataFrame:
    """(sys_id, shuffle, side, summed statistics) of the two sides of every shuffle, and of the systems themselves.

    Every row (sentence and run) swaps the two systems by a fair coin, and the runs of each sentence are permuted.
    One side reads by the permutation, the other by its inverse (by the permutation itself with ``partition``).
    Shuffle -1 is the systems as they are. A sentence has few rows, so chunks of sentences are never large.
    """
    names = _stat_names(metrics)
    wide = _pairs(stats, names, baseline)
    at_most = wide.groupBy("sys_id").agg(F.count_distinct("sent_id").alias("n")).agg(F.max("n")).first()[0] or 0
    cut = _chunked(wide, _chunks(at_most))
    k = len(names)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sys_id, chunk = (int(x) for x in key)
        rng = np.random.default_rng([seed, sys_id, chunk])
        pdf = pdf.sort_values(["sent_id", "opt_id"])
        x = np.zeros((shuffles + 1, k), dtype=np.int64)
        y = np.zeros((shuffles + 1, k), dtype=np.int64)
        runs_of = pdf.groupby("sent_id", sort=False)["opt_id"].transform("size").to_numpy()
        for runs in np.unique(runs_of):
            part = pdf[runs_of == runs]
            a = part[[f"a_{n}" for n in names]].to_numpy(dtype=np.float64)
            d = part[[f"b_{n}" for n in names]].to_numpy(dtype=np.float64) - a
            both = a.sum(axis=0), d.sum(axis=0)
            x[0] += both[0].astype(np.int64)
            y[0] += (both[0] + both[1]).astype(np.int64)
            rows, sents = len(part), len(part) // runs
            patterns = _patterns(int(runs), partition) if runs <= 5 else None
            step = max(1, CELLS // rows)
            for s in range(0, shuffles, step):
                e = min(shuffles, s + step)
                if patterns is not None:
                    which = rng.integers(0, len(patterns[0]), size=(e - s, sents), dtype=np.int32)
                    wx, wy = patterns[0][which], patterns[1][which]
                else:
                    swap = rng.integers(0, 2, size=(e - s, sents, runs), dtype=np.int8)
                    wx, wy = _weights(np.argsort(rng.random((e - s, sents, runs)), axis=2), swap, partition)
                x[s + 1 : e + 1] += (both[0] + wx.reshape(e - s, rows) @ d).astype(np.int64)
                y[s + 1 : e + 1] += (both[0] + wy.reshape(e - s, rows) @ d).astype(np.int64)
        number = np.arange(-1, shuffles)
        return pd.concat(
            pd.DataFrame({"sys_id": sys_id, "shuffle": number, "side": side, **{n: v[:, i] for i, n in enumerate(names)}})
            for side, v in (("x", x), ("y", y))
        )

    schema = "sys_id int, shuffle int, side string, " + ", ".join(f"{n} bigint" for n in names)
    parts = cut.repartition(python_tasks(stats), "sys_id", "chunk").groupBy("sys_id", "chunk").applyInPandas(draw, schema)
    return parts.groupBy("sys_id", "shuffle", "side").agg(*[F.sum(n).alias(n) for n in names])


def hashed_shuffle_rows(stats: DataFrame, shuffles: int, seed: int = 0, baseline: int = 0) -> DataFrame:
    """(sys_id, shuffle, sent_id, opt_id, swap, from_x, from_y): the coin of each row, and the runs both sides read."""
    rows = stats.where(F.col("sys_id") != baseline).select("sys_id", "opt_id", "sent_id")
    each = rows.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    text = [F.lit(seed), F.col("shuffle"), F.col("sys_id"), F.col("sent_id"), F.col("opt_id")]
    drawn = each.withColumn("swap", (h32(F.concat_ws(":", F.lit("s"), *text)) % 2).cast("int")).withColumn("h", h32(F.concat_ws(":", F.lit("p"), *text)))
    own = W.partitionBy("shuffle", "sys_id", "sent_id")
    place = F.row_number().over(own.orderBy("opt_id"))
    ranked = drawn.withColumn("i", place).withColumn("p", F.row_number().over(own.orderBy("h", "opt_id")))
    # p permutes the places of a sentence's runs; the run at place p is read, and by the other side the inverse.
    runs = F.array_sort(F.collect_list(F.struct("i", "opt_id", "p")).over(own))
    forth = F.element_at(runs, F.col("p"))["opt_id"]
    inverse = F.filter(runs, lambda r: r["p"] == F.col("i"))[0]["opt_id"]
    return ranked.select("sys_id", "shuffle", "sent_id", "opt_id", "swap", forth.alias("from_x"), inverse.alias("from_y"))


def hashed_shuffle_sums(stats: DataFrame, metrics: list[Metric], shuffles: int, seed: int = 0, baseline: int = 0) -> DataFrame:
    names = _stat_names(metrics)
    rows = hashed_shuffle_rows(stats, shuffles, seed, baseline)
    wide = _pairs(stats, names, baseline)
    keys = ["sys_id", "sent_id", "opt_id"]

    def side(name: str, from_: str, swapped: str, own: str) -> DataFrame:
        read = rows.select("sys_id", "shuffle", "sent_id", F.col(from_).alias("opt_id"), "swap").join(wide, keys)
        sums = [F.sum(F.when(F.col("swap") == 1, F.col(f"{swapped}_{n}")).otherwise(F.col(f"{own}_{n}"))).alias(n) for n in names]
        return read.groupBy("sys_id", "shuffle").agg(*sums).withColumn("side", F.lit(name))

    real = [
        wide.groupBy("sys_id").agg(*[F.sum(f"{p}_{n}").alias(n) for n in names]).select("sys_id", F.lit(-1).alias("shuffle"), *names, F.lit(s).alias("side"))
        for s, p in (("x", "a"), ("y", "b"))
    ]
    out = side("x", "from_x", "b", "a").unionByName(side("y", "from_y", "a", "b"))
    return out.unionByName(real[0]).unionByName(real[1])


def p_values(sums: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(metric, sys_id, diff, p): share of shuffles whose sides differ by more than the systems do, both with one added."""
    scores = long_scores(sums.select("sys_id", "shuffle", "side", *[m.scored() for m in metrics]), ["sys_id", "shuffle", "side"], metrics)
    sides = scores.groupBy("metric", "sys_id", "shuffle").agg(
        F.abs(F.max(F.when(F.col("side") == "x", F.col("score"))) - F.max(F.when(F.col("side") == "y", F.col("score")))).alias("d")
    )
    real = sides.where("shuffle = -1").select("metric", "sys_id", F.col("d").alias("diff"))
    both = sides.where("shuffle >= 0").join(F.broadcast(real), ["metric", "sys_id"])  # a row per metric and system
    more = F.sum(F.when(F.col("d") > F.col("diff"), 1).otherwise(0))
    return both.groupBy("metric", "sys_id").agg(F.first("diff").alias("diff"), ((more + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
