"""BLEU of orders 1 to 4 against several references, with smoothing of orders without a match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.functions.text import MAX_ORDER
from glossmark.operators.metrics.base import Metric

ORDERS = range(1, MAX_ORDER + 1)


def _counted(group: np.ndarray, gram: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, gram) as sorted keys, and the number of each."""
    return np.unique(group * grams + gram, return_counts=True)


def _gram_ids(tokens: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each order: positions where a gram begins, its id, and the number of ids. left: tokens left at each position."""
    size = int(tokens.max(initial=0)) + 1
    at, ids, count = np.arange(len(tokens)), tokens, size
    for n in ORDERS:
        if n > 1:
            keep = left[at] >= n
            at = at[keep]
            kinds, ids = np.unique(ids[keep] * size + tokens[at + n - 1], return_inverse=True)
            count = len(kinds)
        yield at, ids, max(count, 1)


def batch_stats(hyps: pa.ListArray, refs: pa.ListArray) -> dict[str, np.ndarray]:
    """Statistics of many sentences at once. hyps: tokens of each; refs: tokens of each of its references."""
    rows = len(hyps)
    hyp_len = pc.list_value_length(hyps).to_numpy(zero_copy_only=False).astype(np.int64)
    segments = refs.flatten()
    row_of = np.repeat(np.arange(rows), pc.list_value_length(refs).to_numpy(zero_copy_only=False).astype(np.int64))
    seg_len = pc.list_value_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pa.concat_arrays([hyps.flatten(), segments.flatten()])
    tokens = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.concatenate([hyp_len, seg_len])
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)  # sentences first, then references
    out: dict[str, np.ndarray] = {}
    for n, (at, gram, grams) in zip(ORDERS, _gram_ids(tokens, ends - np.arange(len(tokens)))):
        mine = owner[at] < rows
        hyp_keys, hyp_counts = _counted(owner[at][mine], gram[mine], grams)
        ref_keys, ref_counts = _counted(owner[at][~mine] - rows, gram[~mine], grams)
        keys = row_of[ref_keys // grams] * grams + ref_keys % grams
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], ref_counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        clip_keys, clip = keys[first], np.maximum.reduceat(counts, first) if len(first) else counts
        match = np.zeros(len(hyp_keys), dtype=np.int64)
        if len(clip_keys):
            where = np.minimum(np.searchsorted(clip_keys, hyp_keys), len(clip_keys) - 1)
            match = np.where(clip_keys[where] == hyp_keys, np.minimum(hyp_counts, clip[where]), 0)
        out[f"bleu_att{n}"] = np.maximum(hyp_len - (n - 1), 0)
        out[f"bleu_match{n}"] = np.bincount(hyp_keys // grams, match, minlength=rows).astype(np.int64)
    # The nearest reference length, of two as near the shorter.
    far = np.abs(seg_len - hyp_len[row_of])
    order = np.lexsort((seg_len, far, row_of))
    first = np.append(True, row_of[order][1:] != row_of[order][:-1]) if len(order) else np.zeros(0, dtype=bool)
    out["bleu_ref_len"] = np.zeros(rows, dtype=np.int64)
    out["bleu_ref_len"][row_of[order][first]] = seg_len[order][first]
    return out


class Bleu(Metric):
    name, label = "bleu", "BLEU"
    stats = (*(f"bleu_att{n}" for n in ORDERS), *(f"bleu_match{n}" for n in ORDERS), "bleu_ref_len")
    submetrics = ("bleu1p", "bleu2p", "bleu3p", "bleu4p", "brevity")

    @property
    def description(self) -> str:
        return "BLEU-4, clipped by the maximum over references, closest reference length, smoothed"

    def add_stats(self, sentences: DataFrame) -> DataFrame:
        """Whole batches in numpy: higher-order functions over n-grams took eight times as long."""
        schema = T.StructType(sentences.schema.fields + [T.StructField(c, T.LongType()) for c in self.stats])
        hyp, refs, names = sentences.columns.index("hyp_tokens"), sentences.columns.index("ref_tokens"), self.stats

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    got = batch_stats(batch.column(hyp), batch.column(refs))
                    columns = [*batch.columns, *[pa.array(got[n]) for n in names]]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

        return sentences.mapInArrow(rows, schema)

    def _logs(self) -> list[Column]:
        """Logarithm of each order's precision. Each order without a match halves the smoothed count."""
        out, empty = [], F.lit(0)
        for n in ORDERS:
            att, match = F.col(f"bleu_att{n}"), F.col(f"bleu_match{n}")
            empty = empty + F.when((att > 0) & (match == 0), 1).otherwise(0)
            p = F.when(att == 0, F.lit(1.0)).when(match == 0, 1.0 / (F.pow(F.lit(2.0), empty) * att)).otherwise(match / att)
            out.append(F.ln(p))
        return out

    def _brevity(self) -> Column:
        hyp, ref = F.col("bleu_att1"), F.col("bleu_ref_len")
        return F.when(hyp >= ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1.0 - ref / hyp))

    def score(self) -> Column:
        total = self._brevity() * F.exp(sum(x * 0.25 for x in self._logs()))
        return 100.0 * F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))

    def subscores(self) -> list[Column]:
        """Partial products of the score by order, from 0 to 1, and the brevity penalty."""
        logs, brevity = self._logs(), self._brevity()
        parts = [brevity * F.exp(sum(x * 0.25 for x in logs[:n])) for n in ORDERS]
        return [c.alias(s) for c, s in zip([*parts, brevity], self.submetrics)]
