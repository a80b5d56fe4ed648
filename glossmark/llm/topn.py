"""The N best items of every group, by merging sorted runs.

Stage 1 writes runs: every batch of the input keeps of each group the rows that can still be among its first N,
the rest goes to one of ``buckets`` x ``runs`` files, the bucket by group and the run by a salt, so that a group
of any size is shared by all runs of its bucket. Each file is ordered by group, then by the ranking.
Stage 2 has one task per bucket: a tree of losers merges the runs of the bucket, and once a group has given N rows
every run seeks to its next group, past the rows in memory by a search of group starts, past whole row groups by
their statistics. A task holds one batch of each run, never a group.

Runs lie in the shared folder (``spark.checkpoint.dir``), so a lost executor costs only its own tasks; ``session.clean``
removes them when the results have been read.

Defined results: rows with a null group, or a null or NaN score, are not ranked; -0.0 equals 0.0; nulls among the
tie columns come last; rows that are equal in all columns all count; fewer than N rows give them all; an empty
table gives an empty result. Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.session import shared_folder, spread

#: Rows of a run that a merging task holds at a time.
BATCH = 16_384
#: Bytes of a row group of a run; seeking skips whole ones.
ROW_GROUP = 1 << 20


class LoserTree:
    """A tournament over k sources; ``keys[i]`` is the current key of source i, None when it is at its end."""

    def __init__(self, keys: list):
        self.k = len(keys)
        self.keys = keys
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if ka is None or kb is None:
            return kb is None and (ka is not None or a < b)
        return (ka, a) < (kb, b)

    def _enter(self, i: int) -> None:
        """First entry of a source: it waits at the first empty match on its way up."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    @property
    def winner(self) -> int:
        return self.tree[0]

    def replay(self, i: int, key) -> None:
        """Source i has a new key: play its matches again."""
        self.keys[i] = key
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i


class Run:
    """One sorted file, read batch by batch."""

    def __init__(self, fs: pafs.FileSystem, path: str, groups: int):
        self.file = pq.ParquetFile(fs.open_input_file(path))
        self.groups = groups
        self.row_group = 0
        self.batches: Iterator[pa.RecordBatch] = iter(())
        self.columns: list[list] = []
        self.starts = np.zeros(0, dtype=np.int64)
        self.at = self.size = 0
        self._load(None)

    def _skippable(self, after: tuple | None) -> bool:
        """Whether the statistics of the next row group say that it holds nothing after this group."""
        if after is None:
            return False
        meta = self.file.metadata.row_group(self.row_group)
        bounds = []
        for j in range(self.groups):
            s = meta.column(j).statistics
            if s is None or not s.has_min_max or s.has_null_count and s.null_count:
                return False
            bounds.append((s.min, s.max))
        return all(low == high == g for (low, high), g in zip(bounds, after))

    def _load(self, after: tuple | None) -> None:
        while True:
            batch = next(self.batches, None)
            if batch is None:
                if self.row_group >= self.file.metadata.num_row_groups:
                    self.size = 0
                    return
                if self._skippable(after):
                    self.row_group += 1
                    continue
                self.batches = self.file.iter_batches(BATCH, row_groups=[self.row_group])
                self.row_group += 1
                continue
            if batch.num_rows:
                break
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for j in range(self.groups):
            c = batch.column(j)
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        self.starts = np.flatnonzero(change)
        self.columns = [c.to_pylist() for c in batch.columns]
        self.at, self.size = 0, batch.num_rows

    def key(self) -> tuple | None:
        return tuple(c[self.at] for c in self.columns) if self.size else None

    def group(self) -> tuple | None:
        return tuple(c[self.at] for c in self.columns[: self.groups]) if self.size else None

    def step(self) -> None:
        self.at += 1
        if self.at >= self.size:
            self._load(None)

    def seek_after(self, group: tuple) -> None:
        """To the first row of the next group, if the run stands in this group."""
        while self.size and self.group() == group:
            i = int(np.searchsorted(self.starts, self.at, side="right"))
            if i < len(self.starts):
                self.at = int(self.starts[i])
                return
            self._load(group)


def merge_runs(runs: list[Run], n: int, limit: int = 65_536) -> Iterator[list[tuple]]:
    """The first n rows of every group over all runs, in order, in lists of about ``limit`` rows."""
    if not runs:
        return
    g = runs[0].groups
    tree = LoserTree([r.key() for r in runs])
    out: list[tuple] = []
    group, given = None, 0
    while (key := tree.keys[w := tree.winner]) is not None:
        if key[:g] != group:
            group, given = key[:g], 0
        if given < n:
            out.append(key)
            given += 1
        if given < n:
            runs[w].step()
        else:
            runs[w].seek_after(group)
        tree.replay(w, runs[w].key())
        if len(out) >= limit:
            yield out
            out = []
    if out:
        yield out


def _first_in_batch(groups: list[str], keys: list[str], n: int):
    """Keep what can be among the first n of its group, batch by batch, before anything is shuffled."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in (*groups, *keys)], null_placement="at_end"))
            if not t.num_rows:
                continue
            change = np.zeros(t.num_rows, dtype=bool)
            change[0] = True
            for c in groups:
                col = t.column(c).combine_chunks()
                change[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            rank = np.arange(t.num_rows) - np.repeat(starts, np.diff(np.append(starts, t.num_rows)))
            yield from t.filter(pa.array(rank < n)).combine_chunks().to_batches()

    return prune


def _uri(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_runs(rows: DataFrame, groups: list[str], keys: list[str], n: int, buckets: int, runs: int) -> str:
    """Write the runs of already ascending keys; returns their folder."""
    kept = spread(rows).mapInArrow(_first_in_batch(groups, keys, n), rows.schema)
    bucket = F.pmod(F.xxhash64(*groups), F.lit(buckets)).cast("int")
    salt = F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(runs)).cast("int")
    folder = shared_folder(rows.sparkSession, "runs")
    order = [F.col(c).asc_nulls_last() for c in (*groups, *keys)]
    (
        kept.withColumn("bucket", bucket)
        .withColumn("run", salt)
        .repartition(buckets * runs, "bucket", "run")
        .sortWithinPartitions("bucket", "run", *order)
        .write.option("parquet.block.size", ROW_GROUP)
        .partitionBy("bucket", "run")
        .parquet(folder)
    )
    return folder


def top_n(
    df: DataFrame,
    groups: list[str],
    score: Column,
    ties: list[str],
    n: int,
    bigger_better: bool | Column = True,
    buckets: int | None = None,
    runs: int = 8,
) -> DataFrame:
    """The n best rows of every group: groups and tie columns, best score first, then ties ascending.

    ``bigger_better`` may be a column, where the direction depends on the row. ``runs`` bounds the share of a
    hot group in one file; ``buckets`` is the number of merging tasks, by default what the size of the input needs.
    """
    spark = df.sparkSession
    down = bigger_better if isinstance(bigger_better, Column) else F.lit(bigger_better)
    value = score.cast("double") + F.lit(0.0)
    scored = df.withColumn("__score", value)
    for g in groups:
        scored = scored.where(F.col(g).isNotNull())
    scored = scored.where(F.col("__score").isNotNull() & ~F.isnan("__score"))
    narrow = scored.select(
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
        (F.when(down, -F.col("__score")).otherwise(F.col("__score")) + F.lit(0.0)).alias("k0"),
        *[c.alias(f"k{2 * i + 1 + j}") for i, t in enumerate(ties) for j, c in enumerate((F.col(t).isNull(), F.col(t)))],
    )
    # A null tie is told by its flag before it, so that the merge never compares it with a value.
    if buckets is None:
        # A file for each input partition; as batches give their groups' first rows only, it is never larger than that.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if narrow._jdf.queryExecution().executedPlan().nodeName() != "AdaptiveSparkPlan":
            parts = max(parts, narrow.rdd.getNumPartitions())
        buckets = max(spark.sparkContext.defaultParallelism, -(-parts // runs))
    gs, ks = [c for c in narrow.columns if c[0] == "g"], [c for c in narrow.columns if c[0] == "k"]
    folder = write_runs(narrow, gs, ks, n, buckets, runs)
    fields = [df.schema[g] for g in groups] + [df.schema[t] for t in ties]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    width = len(groups)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _uri(folder)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                where = pafs.FileSelector(f"{base}/bucket={b}", recursive=True, allow_not_found=True)
                paths = sorted(f.path for f in fs.get_file_info(where) if f.path.endswith(".parquet"))
                for rows in merge_runs([Run(fs, p, width) for p in paths], n):
                    columns = list(zip(*rows))
                    kept = [*columns[:width], *columns[width + 2 :: 2]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(kept, arrow)], names=[f.name for f in fields])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in fields]
    tasks = spark.range(buckets, numPartitions=buckets).withColumn("id", F.col("id").cast("int"))
    return tasks.mapInArrow(merge, schema)


CRITERIA = ("total", "bleu", "meteor", "ter")


def entry_scores(nbest: DataFrame) -> DataFrame:
    """(criterion, sent_id, score, orig_rank, entry_id) of each entry and criterion."""
    scores = F.array(
        F.struct(F.lit("total").alias("criterion"), F.col("total").cast("double").alias("score")),
        *[
            F.struct(F.lit(c).alias("criterion"), F.try_element_at("metric_scores", F.lit(i + 1)).alias("score"))
            for i, c in enumerate(CRITERIA[1:])
        ],
    )
    return nbest.select("sent_id", "orig_rank", "entry_id", F.inline(scores))


def best_entries(nbest: DataFrame, n: int = 5) -> DataFrame:
    rows = entry_scores(nbest).withColumn("sent_id", F.col("sent_id").cast("bigint"))
    best = top_n(rows, ["criterion", "sent_id"], F.col("score"), ["orig_rank", "entry_id"], n, F.col("criterion") != "ter")
    return best.select("criterion", "sent_id", "entry_id")
