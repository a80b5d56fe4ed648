"""Column functions over tokenized text. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space at which tokens break; no-break spaces do not.
BREAKS = r"[\t\n\x0B\f\r \x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
#: Joins the tokens of an n-gram; it occurs in no token.
GLUE = "\u0001"
MAX_ORDER = 4


def normalize_ws(text: Column) -> Column:
    """Strip control characters and blanks at both ends, then take ASCII white space as one blank."""
    stripped = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(stripped, r"[\t\n\x0B\f\r ]+", " ")


def tokenize(text: Column) -> Column:
    """Tokens of a text; empty tokens are kept, so an empty text has one empty token."""
    return F.split(text, BREAKS, -1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, each joined to one string; an empty array if there are fewer tokens."""
    if n == 1:
        return tokens
    # Shifted copies zipped together: linear, without slicing every run.
    shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0))) for i in range(n)]
    runs = F.arrays_zip(*[s.alias(f"t{i}") for i, s in enumerate(shifted)])
    return F.transform(runs, lambda r: F.concat_ws(GLUE, *[r[f"t{i}"] for i in range(n)]))


def closest_length(length: Column, lengths: Column) -> Column:
    """The length nearest to ``length``; of two as near, the shorter."""
    nearest = F.array_min(F.transform(lengths, lambda r: F.struct(F.abs(length - r).alias("far"), r.alias("len"))))
    return nearest["len"]


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)
