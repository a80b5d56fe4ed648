"""Passages of held-out test items inside a corpus, copied or edited.

Every document is read once. Its words, freed of case, punctuation, markup and spacing, are looked up among the
words of the items, and word triples of the items found in it are seed hits. Hits of one item that lie close
together form a cluster; the words around a cluster are all that later stages carry. Over all documents it is
counted where a seed stands alone, without a neighbour from its item: a seed is rare if that is seldom, however often
its passage was copied. Clusters with a rare seed, or with several hits in line, are aligned with the item
(Smith-Waterman over words), and the part of the item that the alignment covers decides.

The items are a query set: they are taken in blocks of at most BLOCK_WORDS words, each sent to the executors;
with more items there are more passes over the corpus, nothing else changes.

Defined results: null, empty and blank texts contain nothing; items of under three words are found by no seed and
give nothing; a repeated document row or item gives its pair once; null ids are kept as ids; empty tables give an
empty result; columns besides those named are ignored. Documents may be of any length: a cluster is cut where no
hit follows within the length of the item, and a long one into windows of four times that length, each reaching half
into the next. An alignment that counts is shorter than two lengths, so some window has the whole of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.session import hold, spread

#: Words of items in one block; each block's words and seeds are sent to the executors (about 100 bytes a word).
BLOCK_WORDS = 500_000
#: By default a document contains a passage if an alignment covers so much of the item, with so many of its words equal.
#: Of the 40 % that a part must have, two words of a short item may be changed ones at its ends: they fall out of an alignment.
COVERAGE = 0.35
IDENTITY = 0.7
#: Cells of the largest table of scores that is kept for an alignment.
TABLE = 4_000_000
#: Windows that a task keeps at a time.
WINDOWS = 1_000
#: A seed is rare if it stands alone in at most so many documents, or that share of them.
RARE_COUNT = 20
RARE_SHARE = 1e-3
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0

_IDEOGRAPH = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WORD = rf"[{_IDEOGRAPH}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_IDEOGRAPH}]]+"

CLUSTERS = "doc_id bigint, item_id bigint, seeds array<bigint>, alone boolean, near array<string>"


def words_of(text: Column) -> Column:
    """Lower-case words; an ideograph is a word. Tags of any length, entities and invisible characters are dropped."""
    plain = F.regexp_replace(F.regexp_replace(text, r"</?[A-Za-z!?][^<>]*>|<[^<>]{1,200}>|&#?\w{1,10};", " "), r"\p{Cf}", "")
    return F.regexp_extract_all(F.lower(plain), F.lit(_WORD), F.lit(0))


class Block:
    """The words and seeds of some items, ready for lookup."""

    def __init__(self, rows: list):
        self.items = {r["item_id"]: list(r["words"]) for r in rows}
        vocab = sorted({w for ws in self.items.values() for w in ws})
        self.vocab = pa.array(vocab, type=pa.string())
        at = {w: i for i, w in enumerate(vocab)}
        self.base = len(vocab)
        seeds: list[tuple[int, int, int]] = []
        for n, (item, ws) in enumerate(self.items.items()):
            ids = [at[w] for w in ws]
            seeds += [(self.key(*ids[k : k + 3]), n, k) for k in range(len(ids) - 2)]
        seeds.sort()
        self.ids = list(self.items)
        self.keys = np.array([s[0] for s in seeds], dtype=np.int64)
        self.of = np.array([s[1] for s in seeds], dtype=np.int64)
        self.place = np.array([s[2] for s in seeds], dtype=np.int64)
        self.length = np.array([len(ws) for ws in self.items.values()], dtype=np.int64)

    def key(self, a, b, c):
        return (a * self.base + b) * self.base + c


def _hits(block: Block, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``flat`` where a seed begins, and its index among the block's seeds; one row per pair."""
    none = np.zeros(0, dtype=np.int64)
    if len(flat) < 3 or not len(block.keys):
        return none, none
    ids = pc.fill_null(pc.index_in(flat, value_set=block.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
    for o in (1, 2):  # a triple does not run over the end of a document
        ends = offsets[1:-1] - o
        ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    pos = np.flatnonzero(ok)
    key = block.key(ids[pos], ids[pos + 1], ids[pos + 2])
    low, high = np.searchsorted(block.keys, key, "left"), np.searchsorted(block.keys, key, "right")
    count = high - low
    seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return np.repeat(pos, count), seed


def find_clusters(block: Block, doc_ids: pa.Array, words: pa.ListArray) -> Iterator[tuple]:
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    pos, seed = _hits(block, flat, offsets)
    if not len(pos):
        return
    doc = np.searchsorted(offsets, pos, "right") - 1
    item = block.of[seed]
    order = np.lexsort((pos, item, doc))
    pos, seed, doc, item = pos[order], seed[order], doc[order], item[order]
    reach = block.length[item]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > reach[1:])
    starts = np.append(np.flatnonzero(new), len(pos))
    slant = pos - block.place[seed]
    for first, last in zip(starts[:-1], starts[1:]):
        d, n = int(doc[first]), int(item[first])
        length = int(block.length[n])
        low = max(int(offsets[d]), int(pos[first]) - length)
        high = min(int(offsets[d + 1]), int(pos[last - 1]) + 3 + length)
        for begin in range(low, max(low + 1, high - 2 * length), 2 * length):
            end = min(high, begin + 4 * length)
            a, b = first + np.searchsorted(pos[first:last], (begin, end))
            if a == b:
                continue
            # Hits are in line if another place of the item lies about as far off in the document.
            line = Counter((slant[a:b] // 6).tolist())
            places = len(set(block.place[seed[a:b]].tolist()))
            alone = places < 2 or max(line[k] + line[k + 1] for k in line) < 2
            near = flat.slice(begin, end - begin).to_pylist()
            yield doc_ids[d].as_py(), block.ids[n], sorted(set(block.keys[seed[a:b]].tolist())), alone, near


def _cluster_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = ["doc_id", "item_id", "seeds", "alone", "near"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.string())]
        for batch in batches:
            clusters = find_clusters(block, batch.column(0), batch.column(1))
            while got := list(islice(clusters, WINDOWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*got), types)], names=names)

    return rows


def align(item: list[str], near: list[str]) -> tuple[float, int, int, int]:
    """Best local alignment: its score, the words of the item it covers, its length, its equal words."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([codes[w] for w in item])
    b = np.array([codes.get(w, -1) for w in near])
    return _traced_back(a, b) if len(a) * len(b) <= TABLE else _row_by_row(a, b)


def _traced_back(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int, int]:
    """The alignment read from a whole table of scores, back from the best one."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    ramp = GAP * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, 1:] + GAP, h[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH))
        row = np.concatenate(([0.0], np.maximum(row, 0.0)))
        # Gaps along the row: the best start to the left, less a gap for each step.
        h[i] = np.maximum.accumulate(row - ramp) + ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, steps, equal = float(h[i, j]), int(i), 0, 0
    while i > 0 and j > 0 and h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
        steps += 1
    return score, end - int(i), steps, equal


def _row_by_row(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int, int]:
    """The same for long items: each cell knows where its path began, its length and its equal words, so no table is kept."""
    m = len(b)
    score, begin, steps, equal = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    ramp, at = GAP * np.arange(m + 1), np.arange(m + 1)
    best = (0.0, 0, 0, 0)
    for i, word in enumerate(a, 1):
        same = b == word
        slant, down = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP
        go = slant >= down
        row = np.maximum(np.where(go, slant, down), 0.0)
        alive = row > 0
        row = np.append(0.0, row)
        # Paths end where the score is 0; the next one begins behind this word.
        new_begin = np.append(i, np.where(alive, np.where(go, begin[:-1], begin[1:]), i))
        new_steps = np.append(0, np.where(alive, np.where(go, steps[:-1], steps[1:]) + 1, 0))
        new_equal = np.append(0, np.where(alive, np.where(go, equal[:-1] + same, equal[1:]), 0))
        # Gaps along the row: the best start to the left, less a gap for each step; of equal ones the nearest.
        lifted = row - ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        score, begin, steps, equal = top + ramp, new_begin[source], new_steps[source] + (at - source), new_equal[source]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), i - int(begin[k]), int(steps[k]), int(equal[k]))
    return best


def _aligned_rows(shared, common, coverage: float, identity: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, often = shared.value, common.value
        whole = None  # the last pair found word for word: no other window of it has more
        for pdf in batches:
            out = []
            for doc, item, seeds, alone, near in pdf.itertuples(index=False):
                if (alone and often.issuperset(seeds)) or (doc, item) == whole:
                    continue
                words, near = block.items[item], list(near)
                if sum((Counter(words) & Counter(near)).values()) < identity * coverage * len(words):
                    continue  # too few common words for any alignment
                score, covered, steps, equal = align(words, near)
                if covered >= coverage * len(words) and equal >= identity * steps:
                    out.append((doc, item, score, covered / len(words), equal / steps))
                    if equal == len(words) == steps:
                        whole = (doc, item)
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "coverage", "identity"])

    return rows


def _blocks(items: DataFrame) -> list[list]:
    """The items in blocks of at most BLOCK_WORDS words, read block by block."""
    sized = items.select("item_id", F.size("words").alias("n")).groupBy("item_id").agg(F.max("n").alias("n"))
    blocks: list[list] = [[]]
    total = 0
    for r in sized.orderBy("item_id").toLocalIterator():
        if total and total + r["n"] > BLOCK_WORDS:
            blocks.append([])
            total = 0
        blocks[-1].append(r["item_id"])
        total += r["n"]
    return [b for b in blocks if b]


def find_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, item_id, score, coverage, identity): the best alignment of each pair found, if it covers so much of the item."""
    spark = docs.sparkSession
    worded = items.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text")).alias("words"))
    worded = worded.where("item_id IS NOT NULL AND size(words) >= 3").groupBy("item_id").agg(F.max("words").alias("words"))
    read = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL"))
    read = read.select("doc_id", words_of(F.col("text")).alias("words")).where("size(words) >= 3")
    limit = max(RARE_COUNT, RARE_SHARE * docs.count())
    out = None
    for ids in _blocks(worded):
        rows = worded.where(F.col("item_id").between(ids[0], ids[-1])).collect()
        shared = spark.sparkContext.broadcast(Block(rows))
        clusters = hold(read.mapInArrow(_cluster_rows(shared), CLUSTERS))
        lone = clusters.where("alone").select("doc_id", F.explode("seeds").alias("seed")).groupBy("seed")
        # At most as many seeds as the block has words.
        often = {r["seed"] for r in lone.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()}
        common = spark.sparkContext.broadcast(often)
        found = clusters.mapInPandas(
            _aligned_rows(shared, common, coverage, identity), "doc_id bigint, item_id bigint, score double, coverage double, identity double"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, coverage double, identity double")
    best = F.max(F.struct("score", "coverage", "identity")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
