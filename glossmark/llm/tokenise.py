"""Encode whole texts with a public byte-level BPE vocabulary, in batched numpy merge rounds.

Texts are split by the vocabulary's pattern. The distinct words of a chunk of texts lie in one flat array of
symbols; every round finds the lowest rank of each word, merges its occurrences from the left, and looks up only
the pairs that changed, by binary search over the sorted keys of all mergeable pairs. Words are cut where two
bytes meet that are neighbours in no token, since no merge can cross such a place; finished pieces leave the array.

Defined results: an empty text and a null text have an empty list; strings that look like special tokens are
ordinary text; repeated texts are encoded alike; a null id stays null; an empty table gives an empty result.
Columns besides id and text are ignored. Texts may be of any length; a chunk holds at least one whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that one flat array holds, about.
CHUNK = 4_000_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The vocabulary as arrays: ids of bytes, sorted keys of mergeable pairs with rank, merged id per rank."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.byte_id = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            b = [letters[c] for c in token if c in letters]
            for x, y in zip(b, b[1:]):
                self.joined[x, y] = True
        self.pattern = regex.compile(PATTERN)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all the ranges, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def merge_pieces(m: Merges, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, flat in their order, and the number of ids of each.

    sym: symbols of all pieces, one after another; lens: symbols of each piece, at least one.
    """
    count = len(lens)
    done_piece: list[np.ndarray] = []
    done_len: list[np.ndarray] = []
    done_sym: list[np.ndarray] = []
    piece = np.arange(count)
    rank = np.full(len(sym), NONE, dtype=np.int32)
    if len(sym) > 1:
        rank[:-1] = m.rank(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
    while len(piece):
        starts = np.cumsum(lens) - lens
        low = np.minimum.reduceat(rank, starts)
        over = low == NONE
        if over.any():
            gone = np.repeat(over, lens)
            done_piece.append(piece[over])
            done_len.append(lens[over])
            done_sym.append(sym[gone])
            stay = ~over
            sym, rank = sym[~gone], rank[~gone]
            piece, lens, low = piece[stay], lens[stay], low[stay]
            if not len(piece):
                break
        hits = np.flatnonzero(rank == np.repeat(low, lens))
        # Of hits that overlap (a run of one symbol), every second one counts, from the left.
        first = np.ones(len(hits), dtype=bool)
        first[1:] = hits[1:] != hits[:-1] + 1
        begin = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
        owner = np.repeat(np.arange(len(lens)), lens)[hits]
        sym[hits] = m.merged[rank[hits]]
        keep = np.ones(len(sym), dtype=bool)
        keep[hits + 1] = False
        ends = np.zeros(len(sym), dtype=bool)
        ends[np.cumsum(lens) - 1] = True
        ends[hits] |= ends[hits + 1]
        sym, rank, ends = sym[keep], rank[keep], ends[keep]
        lens = lens - np.bincount(owner, minlength=len(lens))
        at = hits - np.arange(len(hits))
        for p in (at, at[at > 0] - 1):
            inner = p[~ends[p]]
            rank[p] = NONE
            rank[inner] = m.rank(sym[inner], sym[inner + 1])
    pieces, plen, flat = np.concatenate(done_piece), np.concatenate(done_len), np.concatenate(done_sym)
    order = np.argsort(pieces, kind="stable")
    return flat[_ranges((np.cumsum(plen) - plen)[order], plen[order])], plen[order]


def encode_words(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and the number of ids of each. Words are not empty."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    wlen = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word_start = np.zeros(len(data), dtype=bool)
    word_start[np.cumsum(wlen) - wlen] = True
    cut = word_start.copy()
    cut[1:] |= ~m.joined[data[:-1], data[1:]]
    at = np.flatnonzero(cut)
    flat, plen = merge_pieces(m, m.byte_id[data], np.diff(np.append(at, len(data))))
    first = np.flatnonzero(word_start[at])
    return flat, np.add.reduceat(plen, first)


def encode_texts(m: Merges, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and the number of ids of each."""
    index: dict[str, int] = {}
    seen: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            before = len(seen)
            seen += [index.setdefault(w, len(index)) for w in m.pattern.findall(text)]
            counts[i] = len(seen) - before
    if not index:
        return np.zeros(0, dtype=np.int32), counts
    flat, wlen = encode_words(m, [w.encode() for w in index])
    of = np.array(seen, dtype=np.int64)
    ids = flat[_ranges((np.cumsum(wlen) - wlen)[of], wlen[of])]
    ends = np.append(0, np.cumsum(wlen[of]))
    bounds = np.append(0, np.cumsum(counts))
    return ids, np.diff(ends[bounds])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, without a shuffle of its own. ``path`` must be readable on every executor."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                ids, counts = encode_texts(m, texts[a:b])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return spread(narrow).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
