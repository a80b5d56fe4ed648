"""Figures per document that tell prose from lists, tables and junk.

Every line that is not blank becomes a few small observations (how it begins and ends, shares of common words,
numbers, symbols and odd tokens, separators, length). A hidden Markov model labels the lines of each document, in
their order, as prose, list, table or junk; the shares of a document under each label, where a line counts by the
root of its length, and plain figures, come out in one row per document.

The model is trained here, over all lines of all documents: lines that are plain cases of a state are counted
first, then rounds of forward-backward counts let the other lines in. Each round is one pass in which every
partition sums its expected counts, a few hundred numbers, and Spark adds them up.

Defined results: null, empty and blank texts have no words, null means and shares, and are no case; equal texts
have equal figures; a null id stays null; an empty table gives an empty result; columns besides id and text are
ignored. Lines and texts may be of any length; a text is never cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.session import hold, spread

LABELS = ("prose", "list", "table", "junk")
#: Hidden states and their labels: tables are of figures or of words, junk is code and logs, noise, or repetition; a few words
#: that are all there is are prose cut short.
STATES = {"prose": 0, "list": 1, "figures": 2, "cells": 2, "code": 3, "noise": 3, "repetition": 3, "brief": 0}
LABEL_OF = np.eye(len(LABELS))[list(STATES.values())]
#: Observations of a line and their numbers of bins.
BINS = {
    "lead": 6, "end": 4, "common": 6, "numbers": 4, "separators": 4, "symbols": 4, "words": 4, "odd": 4, "length": 4, "repeats": 3, "case": 3, "lines": 3,
}
ROUNDS = 2
#: Documents of more lines are gone through in stretches.
LONG = 2_000
#: Common words that an executor holds at a time: languages beyond that are counted by a stage of their own.
COMMON_BLOCK = 1_000_000

_LEAD = re.compile(r"[ \t]*(?:([•\-*–—·▪◦‣●○+#>☐✓→]+)\s|(\(?(?:\d{1,3}|[A-Za-zа-яα-ω]|[ivxIVX]{1,4})[.):]\)?)\s)")
_CJK = re.compile("[ぁ-ヿ㐀-鿿가-힣\U00020000-\U0002ffff]")
_GAPS = re.compile(r"\t|\||(?<=\S) {2,}(?=\S)| / |;(?=\S)|,(?=[^\s\d])|\.{4,}")
# What stands in a line but is not read: plain tags, strings like special tokens, control and invisible characters.
_UNREAD = re.compile("</?[a-z]{1,6}/?>|<\\|\\w{1,40}\\|>|\\[(?:UNK|CLS|SEP|PAD|MASK)\\]|[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\xad\u200b-\u200f\u2060-\u2064\ufeff]")
_NUMBER = re.compile(r"[-+(]?[\d.,:/%$€£]*\d[\d.,:/%$€£)]*")
_SYMBOL = re.compile(r"[^\w\s.,!?'\"’“”„«»‘—–\-…。、，！？：；;:()（）「」]|_")
_EDGE = ".,!?;:'\"’“”„«»‘()[]{}…。、，！？：；「」—–-*_<>#"
_SENTENCE = ".!?…。！？;·"
_CLOSERS = "\"'’”»)]」*_ \t\r"


def _bin(x: float, *edges: float) -> int:
    """How many of the ascending edges are less."""
    return bisect_left(edges, x)


def _odd(token: str, word: str) -> bool:
    """A token such as prose hardly has: letters with digits, changing case, endless, or one repeated character."""
    if len(token) > 30:
        return True
    has_letter = word.isalpha()  # what was stripped from the word is neither
    has_digit = not has_letter and any(c.isdigit() for c in token)
    has_letter = has_letter or any(c.isalpha() for c in token)
    if has_digit and has_letter or "_" in token or "=" in token or "\\" in token or "/" in token or "@" in token:
        return True
    if len(token) > 2 and has_letter and not token.isupper() and not token[1:].islower() and token[1:] != token[1:].lower():
        return True
    return len(token) > 5 and len(set(token)) <= 2


#: What was seen of tokens in this worker: at most MOST_TOKENS of at most KEPT_LENGTH characters.
_seen: dict[str, tuple[str, str, bool, bool]] = {}
MOST_TOKENS, KEPT_LENGTH = 100_000, 64


def _token(token: str) -> tuple[str, str, bool, bool]:
    """The word in a token, and in lower case; whether the token is a number, and whether it is odd."""
    word = token.strip(_EDGE)
    told = word, word.lower(), _NUMBER.fullmatch(token) is not None, _odd(token, word)
    if len(token) <= KEPT_LENGTH:
        if len(_seen) >= MOST_TOKENS:
            _seen.clear()
        _seen[token] = told
    return told


class Common:
    """Frequent words, and the languages of each."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs: dict[str, list[str]] = {}
        for lang, word in rows:
            self.langs.setdefault(word.lower(), []).append(lang)

    def hits(self, tokens: list[str]) -> int:
        """Occurrences of common words of the one language that has most."""
        found = [lang for langs in filter(None, map(self.langs.get, tokens)) for lang in langs]
        return max(Counter(found).values()) if found else 0


def line_figures(line: str, common: Common, before: int = 0) -> tuple[list[int], tuple[int, int, int, int, int]]:
    """Bins of a line that is not blank (but the last, of the document's lines); its words, their characters, its symbols, its common words, sentence end.

    ``before``: the common words of the best of other languages, if they were counted elsewhere.
    """
    line = _UNREAD.sub("", line)
    raw = line.split()
    if not raw:
        raw = [line := "-"]
    letters = _CJK.findall(line)
    chars = sum(map(len, raw))
    dense = len(letters) * 2 > sum(map(str.isalpha, line)) if letters else False  # a script without blanks
    tokens, lower, numeric, strange = zip(*[_seen.get(t) or _token(t) for t in raw])
    if dense:
        words = letters
        lookup = letters + [a + b for a, b in zip(letters, letters[1:])]
    else:
        words, lookup = list(filter(None, tokens)), list(filter(None, lower))
    count = len(words)
    hits = max(before, common.hits(lookup))
    numbers = sum(numeric)
    odd = 0 if dense else sum(strange)
    symbols = len(_SYMBOL.findall(line))
    tail = line.rstrip(_CLOSERS)
    last = tail[-1] if tail else line.rstrip()[-1]
    end = 1 if last in _SENTENCE[:-2] else 2 if last in ",;:、，：；" else 0 if last.isalnum() else 3
    lead = _LEAD.match(line)
    first = line.lstrip()[0]
    begin = 5 if lead and lead[1] and lead[1] in "–—" else 1 if lead and lead[1] else 2 if lead else 4 if first.isdigit() else 0 if first.isalpha() else 3
    size = sum(map(len, words)) / count if count else 0.0
    start = next((c for c in line if c.isalpha()), "")
    share = hits / count if count else 0.0
    bins = [
        begin,
        end,
        5 if count <= 2 else _bin(share, 0, 0.1, 0.2, 0.3),
        _bin(numbers / len(raw), 0, 0.15, 0.4),
        min(3, len(_GAPS.findall(line.strip()))),
        _bin(symbols / chars, 0.01, 0.05, 0.15),
        _bin(count / 2 if dense else count, 2, 5, 12),
        _bin(odd / len(raw), 0, 0.1, 0.4),
        0 if dense else 1 + _bin(size, 2.5, 11.0),
        0 if len(raw) < 6 else _bin(1 - len(set(raw)) / len(raw), 0.35, 0.6),
        0 if start.isupper() else 1 if start.islower() else 2,
    ]
    return bins, (count, sum(map(len, words)), symbols, hits, int(end == 1))


def plain_state(b: np.ndarray) -> np.ndarray:
    """State of lines that are plain cases, else -1. b: a row of bins per line."""
    lead, end, common, numbers, seps, symbols, words, odd, _, repeats, _, lines = b.T
    out = np.full(len(b), -1)
    clean = (symbols == 0) & (odd == 0) & (repeats < 2) & (lead != 1) & (lead != 2)
    out[clean & (seps <= 1) & (common >= 3) & (common <= 4) & (words >= 2)] = 0
    out[clean & (seps == 0) & (end == 1) & (numbers <= 2) & ((lead == 0) | (lead == 5))] = 0
    out[clean & (lines == 0) & (words <= 1) & (lead == 0) & (numbers == 0) & (seps == 0)] = 7
    out[((lead == 1) | (lead == 2)) & (words <= 1) & (end != 1) & (seps == 0) & (odd <= 1) & (lines > 0)] = 1  # one item is no list
    out[(seps >= 2) & (common == 0) & (numbers >= 2)] = 2
    out[(seps == 3) & (common <= 1) & (numbers < 2) & (repeats < 2) & (odd < 2)] = 3
    out[(symbols == 3) & (seps < 2) & (common != 3) & (common != 4) & (repeats < 2)] = 4
    out[(odd == 3) & (symbols < 3) & (seps < 2) & (repeats < 2)] = 5
    out[(repeats == 2) & (seps < 2)] = 6
    return out


class Model:
    """Log-probabilities of first states, of steps, and of each observation."""

    def __init__(self, first: np.ndarray, step: np.ndarray, seen: list[np.ndarray]):
        self.first = np.log(first / first.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.seen = [np.log(s / s.sum(axis=1, keepdims=True)) for s in seen]

    def emission(self, bins: np.ndarray) -> np.ndarray:
        return sum(s[:, bins[:, f]].T for f, s in enumerate(self.seen))

    @staticmethod
    def of(counts: np.ndarray) -> Model:
        """From summed counts, smoothed: states tend to last from line to line."""
        k = len(STATES)
        first, step, rest = counts[:k] + 5.0, counts[k : k + k * k].reshape(k, k) + 2.0 + 50.0 * np.eye(k), counts[k + k * k :]
        seen, at = [], 0
        for n in BINS.values():
            part = rest[at : at + k * n].reshape(k, n)
            seen.append(part + 0.004 * part.sum(axis=1, keepdims=True) / n + 1.0)
            at += k * n
        for name in ("lines", "odd", "symbols", "repeats"):  # by what it means: one line of plain words
            seen[list(BINS).index(name)][list(STATES).index("brief"), 1:] = 1e-6
        return Model(first, step, seen)


COUNTS = len(STATES) * (1 + len(STATES) + sum(BINS.values()))


def _count_bins(bins: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Sums of each state's weight over the bins of each observation."""
    return [
        np.stack([np.bincount(bins[:, f], weight[:, s], minlength=n) for s in range(len(STATES))]).ravel() for f, n in enumerate(BINS.values())
    ]


def plain_counts(bins: np.ndarray) -> np.ndarray:
    state = plain_state(bins)
    weight = (state[:, None] == np.arange(len(STATES))).astype(float)
    k = len(STATES)
    return np.concatenate([weight.sum(axis=0), np.zeros(k * k), *_count_bins(bins, weight)])


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _loop(e: np.ndarray, before: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward log-probabilities line by line, of several documents at once (axis 0), from those before the first line."""
    out = np.empty_like(e)
    for t in range(e.shape[1]):
        before = out[:, t] = _sum(before[:, :, None] + step, 1) + e[:, t]
    return out


def scan(e: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward log-probabilities of one long document, in about three root-of-n rounds.

    It is cut into stretches as long as they are many. All are gone through at once for their transfer matrices; a walk over the
    stretches tells what each begins with; then all are gone through at once again.
    """
    n, k = e.shape
    size = max(1, int(n**0.5))
    out = np.empty_like(e)
    out[0] = first + e[0]
    many = (n - 1) // size
    parts = e[1 : 1 + many * size].reshape(many, size, k)
    transfer = step[None] + parts[:, 0, None, :]
    for t in range(1, size):
        transfer = _sum(transfer[:, :, :, None] + step, 2) + parts[:, t, None, :]
    enter, last = np.empty((many, k)), out[0]
    for s in range(many):
        enter[s] = last
        last = _sum(last[:, None] + transfer[s], 0)
    out[1 : 1 + many * size] = _loop(parts, enter, step).reshape(-1, k)
    rest = 1 + many * size
    if rest < n:
        out[rest:] = _loop(e[None, rest:], out[None, rest - 1], step)[0]
    return out


def _long_posteriors(model: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of the lines of one long document, and its expected first state and steps."""
    alpha = scan(e, model.first, model.step)
    ahead = scan(e[::-1], np.zeros(e.shape[1]), model.step.T)[::-1]  # of a line and all behind it
    gamma = alpha + ahead - e
    gamma = np.exp(gamma - _sum(gamma, 1)[:, None])
    steps = np.zeros_like(model.step)
    for a in range(0, len(e) - 1, 50_000):
        b = min(len(e) - 1, a + 50_000)
        xi = alpha[a:b, :, None] + model.step + ahead[a + 1 : b + 1, None, :]
        xi = np.exp(xi - xi.max(axis=(1, 2), keepdims=True))
        steps += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, gamma[0], steps


def posteriors(model: Model, bins: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of every line, and expected first states and steps; lines: lines of each document."""
    k = len(STATES)
    e = model.emission(bins)
    ends = np.cumsum(lines)
    gamma, first, steps = np.empty((len(e), k)), np.zeros(k), np.zeros((k, k))
    long = lines > LONG
    for n, end in zip(lines[long], ends[long]):
        gamma[end - n : end], f, s = _long_posteriors(model, e[end - n : end])
        first, steps = first + f, steps + s
    short = np.repeat(~long, lines)
    if short.any():
        gamma[short], f, s = _short_posteriors(model, e[short], lines[~long])
        first, steps = first + f, steps + s
    return gamma, first, steps


def _short_posteriors(model: Model, e: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents go side by side, longest first, so that step t works on those that have a line t."""
    k = len(STATES)
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    sizes = lines[order]
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]) if len(sizes) else 0)]  # documents with a line t
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    for t, n in enumerate(active):
        at = begin[:n] + t
        before = model.first if t == 0 else _sum(alpha[at - 1][:, :, None] + model.step, 1)
        alpha[at] = before + e[at]
    steps = np.zeros((k, k))
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        beta[at - 1] = _sum(model.step + (e[at] + beta[at])[:, None, :], 2)
    gamma = alpha + beta
    gamma = np.exp(gamma - _sum(gamma, 1)[:, None])
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        xi = alpha[at - 1][:, :, None] + model.step + (e[at] + beta[at])[:, None, :]
        xi = np.exp(xi - xi.max(axis=(1, 2), keepdims=True))
        steps += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, gamma[begin].sum(axis=0), steps


def expected_counts(model: Model, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    gamma, first, steps = posteriors(model, bins, lines)
    return np.concatenate([first, steps.ravel(), *_count_bins(bins, gamma)])


LINES = "id bigint, bins binary, sizes array<int>, words bigint, word_chars bigint, chars bigint, symbols bigint, common bigint, ended bigint"


def _split_lines(text: str | None) -> list[str]:
    return re.split("[\n\r\x0b\x0c\x85\u2028\u2029]", text or "")


def _counted_rows(shared):
    """(id, text, counted): common words of each line, of the best language here or before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(shared.value)
        for batch in batches:
            out = []
            for text, counted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = [x for x in _split_lines(text) if x.strip()]
                out.append([line_figures(x, common, c)[1][3] for x, c in zip(lines, counted or [0] * len(lines))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, type=pa.list_(pa.int32()))], names=["id", "text", "counted"])

    return rows


def _common_blocks(common_words: DataFrame) -> list[DataFrame]:
    """The distinct words in blocks of whole languages, of COMMON_BLOCK words where languages allow it."""
    words = common_words.where("word IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "word").distinct()
    blocks: list[list[str]] = [[]]
    total = 0
    for r in words.groupBy("lang").count().orderBy("lang").collect():  # a row per language
        if total and total + r["count"] > COMMON_BLOCK:
            blocks.append([])
            total = 0
        blocks[-1].append(r["lang"])
        total += r["count"]
    return [words.where(F.col("lang").isin(b)) for b in blocks]


def _line_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(shared.value)
        for batch in batches:
            out = []
            for id_, text, counted in zip(*(c.to_pylist() for c in batch.columns)):
                bins, sizes, sums = [], [], [0] * 5
                for line in _split_lines(text):
                    if line.strip():
                        b, figures = line_figures(line, common, counted[len(sizes)] if counted else 0)
                        bins += (*b, 0)
                        sizes.append(sum(map(len, line.split())))
                        sums = [x + y for x, y in zip(sums, figures)]
                bins[len(BINS) - 1 :: len(BINS)] = [_bin(len(sizes), 1, 3)] * len(sizes)
                out.append((id_, bytes(bins), sizes, sums[0], sums[1], sum(sizes), *sums[2:]))
            columns = list(zip(*out)) if out else [()] * 9
            types = [pa.int64(), pa.binary(), pa.list_(pa.int32())] + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types)],
                names=["id", "bins", "sizes", "words", "word_chars", "chars", "symbols", "common", "ended"],
            )

    return rows


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all lines of a batch, and lines of each document that has any."""
    parts = batch.column(at).to_pylist()
    bins = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, len(BINS)).astype(np.int64)
    return bins, np.array([len(p) // len(BINS) for p in parts], dtype=np.int64)


def _summed(lines: DataFrame, count) -> np.ndarray:
    """Sum of an array of counts over all partitions: one small row per partition, added up by Spark."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS)
        for batch in batches:
            bins, n = _unpacked(batch, 0)
            if len(bins):
                total += count(bins, n[n > 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTS), type=pa.int32()), pa.array(total)], names=["i", "x"])

    sums = lines.select("bins").mapInArrow(rows, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(COUNTS)
    for r in sums:
        out[r["i"]] = r["x"]
    return out


def train(lines: DataFrame, rounds: int = ROUNDS) -> Model:
    """Plain cases keep their labels as counts; the expected counts of all lines are added, round by round."""
    seeds = _summed(lines, lambda bins, n: plain_counts(bins))
    model = Model.of(seeds)
    for _ in range(rounds):
        model = Model.of(seeds + _summed(lines, lambda bins, n, m=model: expected_counts(m, bins, n)))
    return model


STATS = (
    "words bigint, lines bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, "
    + ", ".join(f"{s} double" for s in LABELS)
)


def _lines(docs: DataFrame, common_words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The observations of each document's lines and its sums, as LINES."""
    spark = docs.sparkSession
    narrow = spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")))
    texts = narrow.withColumn("counted", F.lit(None).cast("array<int>"))
    shared = [spark.sparkContext.broadcast([tuple(r) for r in block.collect()]) for block in _common_blocks(common_words)]
    for s in shared[:-1]:
        texts = texts.mapInArrow(_counted_rows(s), "id bigint, text string, counted array<int>")
    return texts.mapInArrow(_line_rows(shared[-1]), LINES)


def plain_figures(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the figures of ``text_figures`` that need no labels, in one pass."""
    ratios = {"mean_word_length": ("word_chars", "words"), "symbol_ratio": ("symbols", "chars"), "ended_lines": ("ended", "lines"), "common_words": ("common", "words")}
    counted = _lines(docs, common_words, id_col, text_col).withColumn("lines", F.size("sizes").cast("bigint"))
    return counted.select(F.col("id").alias(id_col), "words", "lines", *[F.try_divide(a, b).alias(n) for n, (a, b) in ratios.items()])


def text_figures(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its figures, and the share of its lines, by the root of their length, of each label."""
    lines = hold(_lines(docs, common_words, id_col, text_col))
    model = train(lines, rounds)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, n = _unpacked(batch, 1)
            sizes = np.sqrt(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float))
            gamma = posteriors(model, bins, n[n > 0])[0] @ LABEL_OF if len(bins) else np.zeros((0, len(LABELS)))
            doc = np.repeat(np.arange(len(n)), n)
            share = np.stack([np.bincount(doc, gamma[:, s] * sizes, minlength=len(n)) for s in range(len(LABELS))])
            count, word_chars, chars, symbols, common, ended = (batch.column(i).to_numpy().astype(float) for i in range(3, 9))
            with np.errstate(divide="ignore", invalid="ignore"):
                ratios = [word_chars / count, symbols / chars, ended / n, common / count, *(share / np.bincount(doc, sizes, minlength=len(n)))]
            blank = [pa.array(r, mask=~np.isfinite(r)) for r in ratios]
            names = [id_col, "words", "lines", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", *LABELS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(n), *blank], names=names)

    return lines.mapInArrow(label, f"`{id_col}` bigint, {STATS}")


def not_prose(figures: DataFrame) -> DataFrame:
    """Documents that are mostly lists, tables and junk."""
    return figures.where("prose < 0.5")
