"""Plain-text corpora: one sentence per line, equal line numbers belong together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmark.functions.text import normalize_ws
from glossmark.operators import badrows
from glossmark.operators.nbest import number_entries

#: Splits up to so many are sent to every task, a row each; more are joined by a shuffle.
MAX_SPLITS = 200_000
#: How a record of an n-best file begins.
RECORD = r'[ \t]*"?[0-9]+"?[ \t]* \|\|\| '


def _with_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``line_no`` of rows that have (file, split, id), ids counting from the first line of a task.

    A file may be split over many tasks: lines are counted per split (a small table), and each line gets the lines of
    the splits before its own plus its place in it. No line is moved for that.
    """
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", "first", before.alias("before"))
    if lines.rdd.getNumPartitions() <= MAX_SPLITS:
        splits = F.broadcast(splits)
    return rows.join(splits, ["file", "split"]).withColumn("line_no", F.col("before") + F.col("id") - F.col("first")).drop("split", "id", "first", "before")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    split = F.col("_metadata.file_block_start")
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), split.alias("split"), (split + F.col("_metadata.file_block_length")).alias("end"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line), lines counted from 0 in each file."""
    lines = _lines(spark, path).drop("end")
    return _with_numbers(lines, lines).select("file", "line_no", "line")


def _pieces(begins: str, longest: int):
    """Lines of each split as records; those that the split before or after it may have a part in are marked by their border.

    A record begins at a line made like a beginning. Only lines that follow it, and are none themselves, may belong to it.
    """
    start = re.compile(begins)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, head, out = None, [], True, []

        def flush(ends: bool) -> None:
            """The lines since the last beginning; where the split ends, their quote may be closed in the next one."""
            if not own:
                return
            border = at[1] if head else at[2] if ends and badrows.quote_open("\n".join(x for _, x in own)) else None
            out.extend((*at[:2], border, i, x) for i, x in (badrows.assembled(own) if border is None else own))

        for batch in batches:
            for file, split, end, i, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split, end) != at:
                    flush(True)
                    at, own, head = (file, split, end), [], True
                if start.match(line):
                    flush(False)
                    own, head = [(i, line)], False
                elif len(own) <= longest:
                    own.append((i, line))
                else:
                    out.append((file, split, None, i, line))
            yield _piece_batch(out)
            out = []
        flush(True)
        yield _piece_batch(out)

    return rows


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["file", "split", "border", "id", "line"])


def quoted_records(spark: SparkSession, path: str, begins: str = RECORD, longest: int = 100) -> DataFrame:
    """(file, line_no, line): records of files in which a quoted field may go on over line breaks.

    A line whose quote stays open is joined with those that follow, up to ``longest``, until the quote is closed. A line
    made like the beginning of a record (``begins``) ends the search, so that a quote that is never closed costs its own
    line and no other. What cannot be joined comes out line by line. ``line_no`` is that of the first line. Lines are read
    in place; only those around the borders of splits are shuffled, to the split before theirs: a record may reach
    into the next split, not beyond it.
    """
    lines = _lines(spark, path)
    pieces = lines.mapInArrow(_pieces(begins, longest), "file string, split bigint, border bigint, id bigint, line string")
    inner = pieces.where("border IS NULL").drop("border")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        """The end of a split and the beginning of the next; a head without a tail before it stands for itself."""
        pdf = pdf.sort_values(["split", "id"])
        number = {i: s for s, i in zip(pdf["split"], pdf["id"])}
        got = badrows.assembled(list(zip(pdf["id"], pdf["line"])))
        return pd.DataFrame([(pdf["file"].iloc[0], number[i], i, x) for i, x in got], columns=["file", "split", "id", "line"])

    # At most ``longest`` lines of each side of a border.
    outer = pieces.where("border IS NOT NULL").groupBy("file", "border").applyInPandas(stitch, "file string, split bigint, id bigint, line string")
    return _with_numbers(inner.unionByName(outer), lines).select("file", "line_no", "line")


def read_hypotheses(spark: SparkSession, paths: list[list[str]]) -> DataFrame:
    """paths[sys][opt]: a file of outputs. All files must have equally many lines, all systems equally many runs."""
    if len({len(p) for p in paths}) > 1:
        raise ValueError("systems differ in their number of optimizer runs")
    out = None
    for sys_id, runs in enumerate(paths):
        for opt_id, path in enumerate(runs):
            rows = numbered_lines(spark, path).select(
                F.lit(sys_id).alias("sys_id"), F.lit(opt_id).alias("opt_id"), F.col("line_no").alias("sent_id"), normalize_ws(F.col("line")).alias("hyp")
            )
            out = rows if out is None else out.unionByName(rows)
    _same_length(out, ["sys_id", "opt_id"])
    return out


def read_refs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One file per reference, all equally long."""
    out = None
    for ref_id, path in enumerate(paths):
        rows = numbered_lines(spark, path).select(
            F.col("line_no").alias("sent_id"), F.lit(ref_id).alias("ref_id"), normalize_ws(F.col("line")).alias("ref")
        )
        out = rows if out is None else out.unionByName(rows)
    _same_length(out, ["ref_id"])
    return out


def _same_length(rows: DataFrame, keys: list[str]) -> None:
    sizes = rows.groupBy(*keys).count().agg(F.min("count"), F.max("count")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"files differ in their number of lines: {sizes[0]} to {sizes[1]}")


def _wrong(line: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"n-best line {what}: "), line))


def nbest_fields(line: Column) -> list[Column]:
    """(sent_id, hyp, feats, total) of ``sentId ||| hyp ||| feats ||| total``.

    The separator splits wherever it stands, a quote is an ordinary character, and fields beyond four are not looked at. Fewer
    than four fields, a sentId that is no whole number and a total that is no number are errors.
    """
    parts = F.split(line, r" \|\|\| ", -1)
    field = lambda k: F.when(F.size(parts) >= 4, parts[k]).otherwise(_wrong(line, "of fewer than four fields"))
    sent_id, total = F.when(field(0).rlike("^[+-]?[0-9]+$"), field(0).try_cast("int")), F.trim(field(3)).try_cast("float")
    return [
        F.coalesce(sent_id, _wrong(line, "without a sentId")).alias("sent_id"), field(1).alias("hyp"), field(2).alias("feats"),
        F.coalesce(total, _wrong(line, "without a total")).alias("total"),
    ]


def read_nbest(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, orig_rank, hyp, feats, total) of every line; ranks follow the lines of the file."""
    lines = numbered_lines(spark, path)
    entries = lines.select(F.col("line_no").alias("line_id"), *nbest_fields(F.col("line")))
    return number_entries(entries).drop("line_id")
