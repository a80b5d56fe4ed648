"""The parquet tables of a data folder, and word tables of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of a word table, which every task holds.
MAX_PAIRS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_table(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A file or folder of lines ``word<TAB>other`` as a dictionary of at most MAX_PAIRS pairs; larger ones are an error."""
    parts = F.split("value", "\t", 2)
    pairs = spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("a"), F.trim(parts[1]).alias("b")).distinct()
    rows = pairs.limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"{path}: more than {MAX_PAIRS} pairs; leave out words that do not occur in the texts")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["a"], []).append(r["b"])
    return out
