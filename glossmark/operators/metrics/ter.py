"""Translation error rate: edits with shifts of blocks, over the mean length of the references.

After Snover et al., 2006: while it does not cost more than it gains, the block shift that lowers the edit distance most
is made. A block must equal words of the reference at the place it moves to, and both must hold words that are not
aligned yet. Empty tokens are no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.functions.numeric import ratio
from glossmark.operators.metrics.base import Metric, row_stats

# ASCII punctuation that is left out if punctuation does not count.
PUNCTUATION = set(".,?:;!\"()")


@dataclass(frozen=True)
class Costs:
    match: float = 0.0
    delete: float = 1.0
    substitute: float = 1.0
    insert: float = 1.0
    shift: float = 1.0

    @property
    def unit(self) -> bool:
        return (self.match, self.delete, self.substitute, self.insert, self.shift) == (0, 1, 1, 1, 1)


class Distance:
    """Edit distance to a fixed reference; with unit costs all cells of a column are bits of one integer."""

    def __init__(self, ref: list[str], costs: Costs):
        self.ref, self.costs = ref, costs
        self.bits: dict[str, int] = {}
        for i, w in enumerate(ref):
            self.bits[w] = self.bits.get(w, 0) | 1 << i

    def of(self, hyp: list[str]) -> float:
        if not self.costs.unit:
            return self.table(hyp)[-1][-1]
        m = len(self.ref)
        if not m:
            return len(hyp)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        bits = self.bits
        for w in hyp:
            eq = bits.get(w, 0)
            x = eq | down
            diagonal = ((((eq & up) + up) ^ up) | eq) & full
            plus = down | (~(diagonal | up) & full)
            minus = diagonal & up
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1 | 1) & full
            minus = (minus << 1) & full
            up = minus | (~(x | plus) & full)
            down = plus & x
        return score

    def table(self, hyp: list[str]) -> list[list[float]]:
        c, ref = self.costs, self.ref
        rows = [[j * c.insert for j in range(len(ref) + 1)]]
        for h in hyp:
            prev = rows[-1]
            row = [prev[0] + c.delete]
            for j, r in enumerate(ref):
                swap = prev[j] + (c.match if h == r else c.substitute)
                row.append(min(swap, prev[j + 1] + c.delete, row[j] + c.insert))
            rows.append(row)
        return rows

    def alignment(self, hyp: list[str]) -> tuple[list[bool], list[bool], list[int]]:
        """Which words of hyp and of the reference are matched, and the place in hyp of each reference word."""
        c, ref, t = self.costs, self.ref, self.table(hyp)
        i, j = len(hyp), len(ref)
        hyp_ok, ref_ok, place = [False] * i, [False] * j, [0] * j
        while i or j:
            if i and j and t[i][j] == t[i - 1][j - 1] + (c.match if hyp[i - 1] == ref[j - 1] else c.substitute):
                i, j = i - 1, j - 1
                hyp_ok[i] = ref_ok[j] = hyp[i] == ref[j]
                place[j] = i
            elif i and t[i][j] == t[i - 1][j] + c.delete:
                i -= 1
            else:
                j -= 1
                place[j] = i - 1
        return hyp_ok, ref_ok, place


def _shifts(hyp: list[str], distance: Distance, far: int, longest: int | None) -> Iterator[tuple[int, int, int]]:
    """Blocks (begin, end) that may move, and the place each may move to: before which word of the rest."""
    ref = distance.ref
    hyp_ok, ref_ok, place = distance.alignment(hyp)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        at.setdefault(w, []).append(j)
    for b in range(len(hyp)):
        for j in at.get(hyp[b], ()):
            n = 0
            wrong_hyp = wrong_ref = False
            while n != longest and b + n < len(hyp) and j + n < len(ref) and hyp[b + n] == ref[j + n]:
                wrong_hyp |= not hyp_ok[b + n]
                wrong_ref |= not ref_ok[j + n]
                n += 1
                if not (wrong_hyp and wrong_ref) or b <= place[j] < b + n or abs(place[j] - b) > far:
                    continue
                # It may stand after the word aligned with any reference word of the block, or with the one before.
                for k in range(j - 1, j + n):
                    after = place[k] if k >= 0 else -1
                    if not b - 1 <= after < b + n:
                        yield b, b + n, after + 1


def edits(hyp: list[str], ref: list[str], costs: Costs = Costs(), far: int = 50, longest: int | None = 10) -> float:
    """Edit cost with shifts of blocks of at most ``longest`` words over at most ``far`` words.

    The shift that lowers the distance most is made, if it lowers it by no less than it costs: one that gains nothing
    by itself may make room for the next. Of equal ones the longest block goes, then the first, then to the first place.
    Distances are exact, so no beam is needed.
    """
    distance = Distance(ref, costs)
    hyp = list(hyp)
    now, spent = distance.of(hyp), 0.0
    while now > 0:
        best: tuple | None = None
        for b, e, to in set(_shifts(hyp, distance, far, longest)):
            block = hyp[b:e]
            moved = hyp[:to] + block + hyp[to:b] + hyp[e:] if to < b else hyp[:b] + hyp[e:to] + block + hyp[to:]
            d = distance.of(moved)
            if d < now and d + costs.shift <= now:
                found = (-d, e - b, -b, -to)
                if best is None or found > best[0]:
                    best = found, moved
        if best is None:
            break
        now, hyp = -best[0][0], best[1]
        spent += costs.shift
    return now + spent


class Ter(Metric):
    name, label, bigger_better = "ter", "TER", False
    stats = ("ter_edits", "ter_words")

    def __init__(self, punctuation: bool = True, max_shift_distance: int = 50, costs: Costs = Costs(), max_block: int | None = 10, shifts: bool = True):
        """``max_block``: words of the longest block that moves, None for any. Without ``shifts`` it is the word error rate."""
        self.punctuation, self.max_shift_distance, self.costs = punctuation, max_shift_distance, costs
        self.max_block, self.shifts = max_block, shifts

    @property
    def description(self) -> str:
        return "Translation error rate with block shifts" if self.shifts else "Word error rate"

    def words(self, tokens: list[str]) -> list[str]:
        return [w for t in tokens if (w := t.lower()) and (self.punctuation or w not in PUNCTUATION)]

    def sentence(self, hyp: list[str], refs: list[list[str]]) -> tuple[int, int]:
        """Fewest edits over the references, and their mean length; both cut to whole numbers."""
        tokens, split = self.words(hyp), [self.words(r) for r in refs]
        if self.shifts:
            fewest = min(edits(tokens, r, self.costs, self.max_shift_distance, self.max_block) for r in split)
        else:
            fewest = min(Distance(r, self.costs).of(tokens) for r in split)
        return int(fewest), int(sum(map(len, split)) / len(split))

    def add_stats(self, sentences: DataFrame) -> DataFrame:
        return row_stats(sentences, [T.StructField(c, T.LongType()) for c in self.stats], self.sentence)

    def score(self) -> Column:
        return 100.0 * ratio(F.col("ter_edits"), F.col("ter_words"))
