"""What a metric is: additive statistics per sentence, and a score of their sums."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Results of equal rows that a task keeps at a time.
KNOWN = 10_000


def row_stats(sentences: DataFrame, fields: list[T.StructField], work: Callable[[list, list], tuple]) -> DataFrame:
    """``work(hyp_tokens, ref_tokens)`` of every row as new columns; of equal rows that meet in a task only once."""
    schema = T.StructType([*sentences.schema.fields, *fields])
    hyp, refs = sentences.columns.index("hyp_tokens"), sentences.columns.index("ref_tokens")
    types = [to_arrow_type(f.dataType) for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            got = []
            for h, r in zip(batch.column(hyp).to_pylist(), batch.column(refs).to_pylist()):
                key = (tuple(h), tuple(map(tuple, r)))
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = work(h, r)
                got.append(known[key])
            columns = [pa.array([g[i] for g in got], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in fields]])

    return sentences.mapInArrow(rows, schema)


class Metric(ABC):
    """A metric of one's own defines these.

    ``stats`` lists names of numeric columns that add up over sentences. ``add_stats`` adds them to a frame that
    has ``hyp`` and ``refs`` (an array of texts), ``hyp_tokens`` and ``ref_tokens`` (an array of arrays);
    ``score`` turns columns, of one sentence or summed, into a score.
    """

    name: str
    label: str
    bigger_better: bool = True
    stats: tuple[str, ...]
    submetrics: tuple[str, ...] = ()

    @property
    @abstractmethod
    def description(self) -> str: ...

    @abstractmethod
    def add_stats(self, sentences: DataFrame) -> DataFrame: ...

    @abstractmethod
    def score(self) -> Column: ...

    def subscores(self) -> list[Column]:
        """A column for each name in ``submetrics``."""
        return []

    def sums(self) -> list[Column]:
        """Aggregates that merge statistics."""
        return [F.sum(c).alias(c) for c in self.stats]

    def scored(self) -> Column:
        return self.score().alias(self.name)
