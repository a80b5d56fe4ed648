"""Length of the output as a percentage of the closest reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.numeric import ratio
from glossmark.functions.text import closest_length
from glossmark.operators.metrics.base import Metric


class Length(Metric):
    name, label = "length", "Length"
    stats = ("length_hyp", "length_ref")

    @property
    def description(self) -> str:
        return "Hypothesis length over reference length as a percent"

    def add_stats(self, sentences: DataFrame) -> DataFrame:
        size = F.size("hyp_tokens")
        picked = closest_length(size, F.transform("ref_tokens", F.size))
        return sentences.withColumns({"length_hyp": size.cast("bigint"), "length_ref": picked.cast("bigint")})

    def score(self) -> Column:
        return 100.0 * ratio(F.col("length_hyp"), F.col("length_ref"))
