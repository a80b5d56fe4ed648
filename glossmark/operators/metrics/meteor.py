"""METEOR: matches of words by stages, precision and recall weighted by stage, and a penalty for fragments.

After Denkowski and Lavie, 2011. Stages: exact, stem, synonym, paraphrase. Content and function words weigh differently.
The tables of synonyms, paraphrases and function words are given by the user; those of the original are not part of this
package, so scores are comparable with it only as far as the tables are the same.

The alignment covers as many words of both sides as it can, every word once; of those it has the fewest chunks, and then
the smallest sum of distances. It is found by a beam search over the words of the output. Words that match in one place
only are settled without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.functions.numeric import ratio
from glossmark.operators.metrics.base import Metric, row_stats

STAGES = ("exact", "stem", "synonym", "paraphrase")
SIDES = ("hyp", "ref")
KINDS = ("content", "function")
# Endings that the plain stemmer takes off.
ENDINGS = ("ational", "iveness", "fulness", "ously", "ingly", "edly", "ings", "ing", "ed", "es", "ly", "s")
# Published parameters (alpha, beta, gamma), share of content words and weights of the stages, by task.
TASKS = {
    "rank": ((0.85, 0.2, 0.6), 0.75, (1.0, 0.6, 0.8, 0.6)),
    "tune": ((0.5, 1.0, 0.5), 0.5, (1.0, 0.5, 0.5, 0.5)),
}
#: Tasks whose parameters the user must give.
OTHER_TASKS = ("adq", "hter", "li")
# Two-letter codes of languages that have modules of their own.
LANGUAGES = ("en", "cz", "de", "es", "fr", "ar", "da", "fi", "hu", "it", "nl", "no", "pt", "ro", "ru", "se", "tr")

Match = tuple[int, int, int, int, int]  # place and words in hyp, place and words in ref, stage


def plain_stem(word: str) -> str:
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return word


def word_matches(hyp: list[str], ref: list[str], keys: list[Callable[[str], set[str]] | None]) -> Iterator[Match]:
    """Pairs of words that share a key of a stage, in their first such stage."""
    seen: set[tuple[int, int]] = set()
    for stage, key in enumerate(keys):
        if key is None:
            continue
        places: dict[str, list[int]] = {}
        for j, w in enumerate(ref):
            for k in key(w):
                places.setdefault(k, []).append(j)
        for i, w in enumerate(hyp):
            for j in sorted({j for k in key(w) for j in places.get(k, ())}):
                if (i, j) not in seen:
                    seen.add((i, j))
                    yield i, 1, j, 1, stage


def phrase_matches(hyp: list[str], ref: list[str], table: dict[str, set[str]], longest: int, stage: int) -> Iterator[Match]:
    """Phrases of the output whose paraphrase stands in the reference."""
    places: dict[str, list[tuple[int, int]]] = {}
    for j in range(len(ref)):
        for n in range(1, min(longest, len(ref) - j) + 1):
            places.setdefault(" ".join(ref[j : j + n]), []).append((j, n))
    for i in range(len(hyp)):
        for n in range(1, min(longest, len(hyp) - i) + 1):
            for other in table.get(" ".join(hyp[i : i + n]), ()):
                for j, m in places.get(other, ()):
                    yield i, n, j, m, stage


def align(size: int, matches: Iterable[Match], beam: int = 40) -> list[Match]:
    """The best set of matches that do not overlap, for an output of ``size`` words."""
    options: list[list[Match]] = [[] for _ in range(size)]
    wanted_h, wanted_r = [0] * size, {}
    for m in matches:
        options[m[0]].append(m)
        for i in range(m[0], m[0] + m[1]):
            wanted_h[i] += 1
        for j in range(m[2], m[2] + m[3]):
            wanted_r[j] = wanted_r.get(j, 0) + 1
    # cost (covered words as a negative number, chunks, distance), words of ref in use, ends of the last match, matches
    start = ((0, 0, 0), 0, -1, -1, None)
    heads: list[dict[tuple, tuple]] = [{} for _ in range(size + 1)]
    heads[0][0, -1, -1] = start
    for i in range(size):
        states = heads[i].values()
        if len(states) > beam:
            states = sorted(states, key=lambda s: s[0])[:beam]
        heads[i] = {}
        own = options[i]
        settled = len(own) == 1 and wanted_h[i] == own[0][1] == own[0][3] == 1 and wanted_r[own[0][2]] == 1
        for state in states:
            (covered, chunks, far), used, end_h, end_r, chain = state
            if not settled:
                _keep(heads[i + 1], state)
            for m in own:
                span = ((1 << m[3]) - 1) << m[2]
                if used & span:
                    continue
                joins = end_h == i and end_r == m[2]
                cost = (covered - m[1] - m[3], chunks + (not joins), far + abs(i - m[2]))
                _keep(heads[i + m[1]], (cost, used | span, i + m[1], m[2] + m[3], (m, chain)))
    chain = min(heads[size].values(), key=lambda s: s[0])[4]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def _keep(states: dict[tuple, tuple], state: tuple) -> None:
    """Of states that can go on alike the cheapest stays, the first of equals."""
    known = states.get(state[1:4])
    if known is None or state[0] < known[0]:
        states[state[1:4]] = state


class Meteor(Metric):
    name, label = "meteor", "METEOR"
    stats = (
        *(f"meteor_{side}_{kind}" for side in SIDES for kind in KINDS),
        *(f"meteor_{side}_{kind}_{s}" for s in STAGES for side in SIDES for kind in KINDS),
        "meteor_chunks",
    )
    submetrics = ("prec", "rec", "frag")

    def __init__(
        self,
        modules: tuple[str, ...] | None = None,
        weights: tuple[float, ...] | None = None,
        params: tuple[float, ...] | None = None,
        stem: Callable[[str], str] = plain_stem,
        synonyms: dict[str, list[str]] | None = None,
        paraphrases: dict[str, list[str]] | None = None,
        function_words: Iterable[str] = (),
        keep_punctuation: bool = True,
        language: str = "en",
        task: str = "rank",
        beam: int = 40,
    ):
        """``modules``: exact and stem, and those whose tables are given, by default. ``params``: alpha, beta, gamma and,
        if there is a fourth, the share of content words; by default those published for the task."""
        if language not in LANGUAGES and task != "li":
            raise ValueError(f"unknown language {language!r}; there are {LANGUAGES}, or any with the task li")
        if task not in TASKS and task not in OTHER_TASKS:
            raise ValueError(f"unknown task {task!r}; there are {(*TASKS, *OTHER_TASKS)}")
        if task in OTHER_TASKS and (params is None or weights is None):
            raise ValueError(f"the task {task!r} needs params and weights")
        self.synonyms = {k.lower(): [x.lower() for x in v] for k, v in (synonyms or {}).items()}
        self.paraphrases: dict[str, set[str]] = {}
        for a, others in (paraphrases or {}).items():
            for b in others:  # a paraphrase holds in both directions
                self.paraphrases.setdefault(a.lower(), set()).add(b.lower())
                self.paraphrases.setdefault(b.lower(), set()).add(a.lower())
        self.longest = max((len(p.split(" ")) for p in self.paraphrases), default=0)
        if modules is None:
            modules = tuple(m for m in STAGES if m in STAGES[:2] or (m == "synonym" and self.synonyms) or (m == "paraphrase" and self.paraphrases))
        if unknown := [m for m in modules if m not in STAGES]:
            raise ValueError(f"unknown modules {unknown}; there are {STAGES}")
        of_task = TASKS.get(task, TASKS["rank"])
        weights = weights if weights is not None else tuple(of_task[2][STAGES.index(m)] for m in modules)
        if len(weights) != len(modules):
            raise ValueError(f"{len(modules)} modules and {len(weights)} weights")
        params = tuple(params) if params is not None else of_task[0]
        self.modules, self.weights, self.params = tuple(modules), tuple(weights), params[:3]
        self.content = params[3] if len(params) > 3 else of_task[1]
        self.function_words = frozenset(w.lower() for w in function_words)
        self.stem, self.keep_punctuation, self.language, self.task, self.beam = stem, keep_punctuation, language, task, beam

    @property
    def description(self) -> str:
        return f"METEOR {self.language} on {self.task} task with modules {', '.join(self.modules)}{' NOT' if self.keep_punctuation else ''} ignoring punctuation"

    def words(self, tokens: list[str]) -> list[str]:
        words = [w for t in tokens if (w := t.lower())]
        return words if self.keep_punctuation else [w for w in words if any(c.isalnum() for c in w)]

    def matches(self, hyp: list[str], ref: list[str]) -> list[Match]:
        """The alignment; stages are numbered as in ``modules``."""
        kinds = {"exact": lambda w: {w}, "stem": lambda w: {self.stem(w)}, "synonym": lambda w: {w, *self.synonyms.get(w, ())}}
        found = list(word_matches(hyp, ref, [kinds.get(m) for m in self.modules]))
        if "paraphrase" in self.modules and self.paraphrases:
            found += phrase_matches(hyp, ref, self.paraphrases, self.longest, self.modules.index("paraphrase"))
        return align(len(hyp), found, self.beam)

    def counts(self, hyp: list[str], ref: list[str]) -> tuple[dict[str, int], list[str], list[str]]:
        got = dict.fromkeys(self.stats, 0)
        texts, left = {"hyp": hyp, "ref": ref}, {"hyp": list(hyp), "ref": list(ref)}
        kind = lambda w: KINDS[w in self.function_words]
        for side, words in texts.items():
            for w in words:
                got[f"meteor_{side}_{kind(w)}"] += 1
        end = None
        for i, n, j, m, stage in self.matches(hyp, ref):
            got["meteor_chunks"] += end != (i, j)
            end = (i + n, j + m)
            for side, at, size in (("hyp", i, n), ("ref", j, m)):
                for w in texts[side][at : at + size]:
                    got[f"meteor_{side}_{kind(w)}_{self.modules[stage]}"] += 1
                    left[side].remove(w)
        return got, left["hyp"], left["ref"]

    def value(self, c: dict[str, int]) -> float:
        """The score of plain counts, as ``score`` has it of columns."""
        alpha, beta, gamma = self.params
        share = dict(zip(KINDS, (self.content, 1.0 - self.content)))
        sums, matched, lengths = {}, {}, {}
        for side in SIDES:
            weighted = sum(w * share[k] * c[f"meteor_{side}_{k}_{m}"] for m, w in zip(self.modules, self.weights) for k in KINDS)
            length = sum(share[k] * c[f"meteor_{side}_{k}"] for k in KINDS)
            sums[side] = weighted / length if length else 0.0
            matched[side] = sum(c[f"meteor_{side}_{k}_{m}"] for m in self.modules for k in KINDS)
            lengths[side] = sum(c[f"meteor_{side}_{k}"] for k in KINDS)
        p, r = sums["hyp"], sums["ref"]
        if not p or not r:
            return 0.0
        whole = c["meteor_chunks"] == 1 and matched == lengths
        frag = 0.0 if whole else c["meteor_chunks"] / ((matched["hyp"] + matched["ref"]) / 2)
        return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * frag**beta)

    def sentence(self, hyp: list[str], refs: list[list[str]]) -> tuple[dict[str, int], list[str], list[str]]:
        """Counts against the reference that scores best, the first of equals, and the words left over."""
        tokens = self.words(hyp)
        return max((self.counts(tokens, self.words(r)) for r in refs), key=lambda got: self.value(got[0]))

    def add_stats(self, sentences: DataFrame) -> DataFrame:
        return row_stats(sentences, [T.StructField(c, T.LongType()) for c in self.stats], lambda h, r: tuple(self.sentence(h, r)[0].values()))

    def unmatched(self, sentences: DataFrame) -> DataFrame:
        """``left_hyp`` and ``left_ref``: the words of each side that match nothing, with their repetitions."""
        words = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("left_hyp", "left_ref")]
        return row_stats(sentences, words, lambda h, r: self.sentence(h, r)[1:])

    def _parts(self) -> tuple[Column, Column, Column]:
        alpha, beta, gamma = self.params
        share = dict(zip(KINDS, (self.content, 1.0 - self.content)))
        sums, matched, lengths = [], [], []
        for side in SIDES:
            weighted = sum(w * share[k] * F.col(f"meteor_{side}_{k}_{m}") for m, w in zip(self.modules, self.weights) for k in KINDS)
            sums.append(F.coalesce(ratio(weighted, sum(share[k] * F.col(f"meteor_{side}_{k}") for k in KINDS)), F.lit(0.0)))
            matched.append(sum(F.col(f"meteor_{side}_{k}_{m}") for m in self.modules for k in KINDS))
            lengths.append(sum(F.col(f"meteor_{side}_{k}") for k in KINDS))
        chunks = F.col("meteor_chunks")
        whole = (chunks == 1) & (matched[0] == lengths[0]) & (matched[1] == lengths[1])
        frag = F.when(whole, F.lit(0.0)).otherwise(ratio(chunks, (matched[0] + matched[1]) / 2))
        return *sums, F.coalesce(gamma * F.pow(frag, F.lit(beta)), F.lit(0.0))

    def score(self) -> Column:
        p, r, pen = self._parts()
        alpha = self.params[0]
        return 100.0 * F.coalesce(ratio(p * r, alpha * p + (1 - alpha) * r), F.lit(0.0)) * (1.0 - pen)

    def subscores(self) -> list[Column]:
        return [c.alias(n) for c, n in zip(self._parts(), self.submetrics)]
