"""Row numbers within groups of any size.

A window gives a whole group to one task, which a group with a third of all rows does not bear. Groups up to WINDOW rows
are numbered by a window. The rows of larger ones are sorted over all tasks by group and order; each task numbers its own
stretch, and groups that go on from one task to the next (at most one per task) get the rows before them added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.session import shared_folder


#: Rows of a group that one task numbers.
WINDOW = 1_000_000


def kept(df: DataFrame, what: str) -> DataFrame:
    """The frame as a table in the shared folder: its rows stay the same if an executor is lost."""
    folder = shared_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _numbered(group: list[int], names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            first = tuple(batch.column(g)[0].as_py() for g in group)
            new[0] = first != last
            for g in group:
                c = batch.column(g)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, place, -1))
            local = np.where(begin < 0, count + place, place - begin)
            last, count = tuple(batch.column(g)[n - 1].as_py() for g in group), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(local)], names=[*names, "__part", "__local"])

    return rows


def parted(df: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that a task can number, rows of larger groups or None). The input is read once for the sizes."""
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WINDOW).select(*group)
    if large.isEmpty():
        return df, None
    large = F.broadcast(large)  # of WINDOW rows or more each, so there are few
    return df.join(large, group, "left_anti"), df.join(large, group, "left_semi")


def window_place(group: list[str], order: list[Column]) -> Column:
    return (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("bigint")


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str, most: int | None = None) -> DataFrame:
    """``name``: the place of each row in its group, from 0. Groups must not be null; the order should be total.

    ``most``: no group has more rows, if that is known; up to WINDOW the groups need not be counted then.
    """
    small, large = (df, None) if most is not None and most <= WINDOW else parted(df, group)
    small = small.select(*df.columns, window_place(group, order).alias(name))
    return small if large is None else small.unionByName(number_over_tasks(large, group, order, name))


def number_over_tasks(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """As number_rows, over all tasks whatever the groups' sizes."""
    keys = [*[F.col(g) for g in group], *order]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])
    local = kept(ordered.mapInArrow(_numbered([df.columns.index(g) for g in group], df.columns), schema), "ranked")
    sizes = local.groupBy(*group, "__part").agg((F.max("__local") + 1).alias("n"))
    earlier = F.sum("n").over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    going_on = sizes.select(*group, "__part", earlier.alias("__before")).where("__before IS NOT NULL")
    # At most one group goes on into each task, so this is bounded by the number of tasks.
    joined = local.join(F.broadcast(going_on), [*group, "__part"], "left")
    return joined.select(*df.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(name))
