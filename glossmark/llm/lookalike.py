"""One consistent form for texts that look the same but differ in their characters.

The canonical form drops invisible characters, turns every kind of space into a blank (runs into one, none at the
ends), folds full-width, half-width and other same-looking compatibility forms, maps look-alike letters of other
scripts to Latin ones, and composes accents. What can be seen stays: letters, digits, case, accents, raised
digits, and a digit in place of a letter.

Most text needs none of this. A quick-check property per character, derived from the rules below and the
normalization data of ``unicodedata``, tells which characters are unstable: those that some rule changes and those
that may combine with the one before them. Only runs of unstable characters, together with the character before
each as context, are normalized; the results are spliced into the rest.

Defined results: null stays null; an empty or blank text gives an empty one; a text may be of any length; equal
texts give equal forms; null ids and hypotheses match nothing; repeated references count once, repeated entries
each with their own id; empty tables give empty results; columns besides those named are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.session import spread

# Letters of other scripts, and letter symbols, that look like Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӕ": "æ", "ә": "ə", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӕ": "Æ", "Ә": "Ə", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "Տ": "S", "Լ": "L", "Օ": "O",
    "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x",
    "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X",
    "ℎ": "h", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Ranges of characters that show nothing.
INVISIBLE = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
# Spaces besides those of category Zs, Zl, Zp, and the blank pattern that looks like one.
SPACES = "\t\n\v\f\r\x85\u2800"
# Blocks whose compatibility forms look like what they stand for.
FOLDED = ((0x2E80, 0x2FDF), (0x3131, 0x318E), (0xFB00, 0xFB06), (0xFF01, 0xFFDC), (0xFFE0, 0xFFE2), (0xFFE4, 0xFFE6), (0xFFE8, 0xFFEE))
#: Code points looked at: planes 0 to 2, and the plane of tags and variation selectors.
PLANES = ((0, 0x30000), (0xE0000, 0xE1000))

_ASCII_SPACE = r"[\t\n\x0B\f\r ]+"


def _within(c: int, ranges) -> bool:
    return any(a <= c <= b for a, b in ranges)


def plain_form(c: str) -> str:
    """What one character stands for, before accents are composed."""
    code = ord(c)
    if c in SPACES or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if _within(code, INVISIBLE):
        return ""
    if _within(code, FOLDED):
        return "".join(plain_form(x) if x != c else x for x in unicodedata.normalize("NFKC", c))
    return LOOKALIKES.get(c, c)


def normal_form(text: str) -> str:
    """Canonical form of a segment that interacts with nothing outside it; also the brute-force form of a text."""
    plain = "".join(map(plain_form, text))
    split = unicodedata.normalize("NFD", plain)
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in split))


@lru_cache(maxsize=1)
def unstable_runs() -> re.Pattern:
    """Runs of unstable characters."""
    marks = {*range(0x1160, 0x1200), *map(ord, LOOKALIKES), *map(ord, SPACES)}
    for low, high in (*INVISIBLE, *FOLDED):
        marks.update(range(low, high + 1))
    for low, high in PLANES:
        for code in range(low, high):
            c = chr(code)
            if unicodedata.combining(c) or unicodedata.category(c)[0] == "Z":
                marks.add(code)
            elif (parts := unicodedata.decomposition(c)) and parts[0] != "<":
                if normal_form(c) != c:
                    marks.add(code)
                if " " in parts:
                    marks.add(int(parts.split()[1], 16))  # it may combine with a character before it
    marks.discard(0x20)
    spans: list[list[int]] = []
    for code in sorted(marks):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]+")


def spliced(word: str) -> str:
    """The word with its unstable runs normalized, each with the character before it as context."""
    out: list[str] = []
    done = 0
    runs = [m.span() for m in unstable_runs().finditer(word)]
    i = 0
    while i < len(runs):
        begin, end = max(runs[i][0] - 1, done), runs[i][1]
        while i + 1 < len(runs) and runs[i + 1][0] <= end + 1:  # the next run's context belongs to this one
            i += 1
            end = runs[i][1]
        out += (word[done:begin], normal_form(word[begin:end]))
        done = end
        i += 1
    return word if not done else "".join(out) + word[done:]


#: Forms of words seen by this worker; a blank combines with nothing, so words are independent.
_known: dict[str, str] = {}


def canonical(text: str | None) -> str | None:
    if text is None:
        return None
    words = text.split(" ")
    forms = []
    for w in words:
        if (form := _known.get(w)) is None:
            form = spliced(w)
            if len(w) <= 64:
                if len(_known) > 300_000:
                    _known.clear()
                _known[w] = form
        forms.append(form)
    return re.sub(" +", " ", " ".join(forms)).strip(" ")


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def squeezed(text: Column) -> Column:
    """The text trimmed, with every run of ASCII white space as one blank."""
    return F.trim(F.regexp_replace(text, _ASCII_SPACE, " "))


def _keys(text: Column, name: str) -> list[Column]:
    """A text as 128 bits: what is shuffled and compared in its place."""
    return [F.xxhash64(text, F.lit(0)).alias(f"{name}0"), F.xxhash64(F.lit(1), text).alias(f"{name}1")]


def _forms(df: DataFrame, ids: list[Column], text: str) -> DataFrame:
    narrow = spread(df.select(*ids, F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("sent_id").isNotNull()))
    formed = narrow.withColumn("form", canonical_text("text"))
    names = [c for c in narrow.columns if c != "text"]
    return formed.select(*names, *_keys(F.col("form"), "c"), *_keys(squeezed(F.col("text")), "t"))


def same_looking(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """(sent_id, ref_id, entry_id) whose texts differ as they are but not in canonical form.

    Only ids and hashes are shuffled, on sentence and form together, so that a sentence with very many
    entries is spread over the partitions by its texts.
    """
    e = _forms(entries, [F.col("sent_id").cast("bigint").alias("sent_id"), F.col("entry_id")], "hyp")
    r = _forms(refs, [F.col("sent_id").cast("bigint").alias("sent_id"), F.col("ref_id")], "ref").distinct()
    r = r.withColumnsRenamed({"t0": "u0", "t1": "u1"})
    pairs = e.join(r, ["sent_id", "c0", "c1"]).where((F.col("t0") != F.col("u0")) | (F.col("t1") != F.col("u1")))
    return pairs.select("sent_id", "ref_id", "entry_id").distinct()
