"""Text that was decoded with the wrong character encoding: find it, and give the original back where it can be.

Every distinct clean word of the corpus is encoded and misread under every chain of encodings that is known to
happen, also twice, with losses, and lower-cased afterwards. The garbled forms are hash-joined with the distinct
suspect tokens: those of the searched texts that are no clean words, nor clean words in disguise (full-width
forms, look-alike letters). A match is verified by what it is made of, see ``judge``, or by the row it stands in,
see ``row_verified``, and its original replaces the token.

Each result names its ``origin``: ``table`` for a match of the forms, ``row`` for one that its row had to verify, ``trace``
for a token that no clean word explains, but that holds what only misreading leaves (U+FFFD, or units that read as
proper UTF-8 again). Originals come from the table alone; a token told by its trace has none.

The table of forms is never stored whole: generating tasks emit the forms that a bitmap of the suspects lets
through. The bitmap grows with the suspects up to MOST_BITS; beyond, it lets more forms through to the join, which is
exact: at most all forms of the distinct words, far fewer than the tokens of a corpus. Words and suspects are distinct,
so no token, however frequent, is a hot key before the last join.

Defined results: null and empty texts hold nothing garbled and stay as they are; only ASCII white space ends a
token, and is kept; tokens may be of any length; equal tokens are judged alike, so repeated rows are; a null id stays
null; an empty table gives an empty result; columns besides those named are ignored.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.llm.lookalike import canonical
from glossmark.operators.ranking import kept
from glossmark.session import hold

# How UTF-8 is misread.
UTF8_READ_AS = (
    "cp1252", "latin-1", "iso8859-15", "iso8859-2", "cp1250", "cp1251", "cp1254", "cp1253", "cp437", "cp850", "mac_roman", "koi8-r",
    "cp866", "gb18030", "big5", "cp932", "euc_kr", "ascii",
)
# How UTF-8 is misread twice.
UTF8_TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp437", "cp437"), ("cp1251", "cp1251"))
# How older encodings are misread, by family.
LEGACY = (
    (("cp1252", "mac_roman", "cp850", "cp437"), ("utf-8", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r")),
    (("cp1250", "iso8859-2", "cp852"), ("utf-8", "cp1252", "latin-1", "cp437", "mac_roman")),
    (("cp1254",), ("utf-8", "cp1252", "iso8859-15", "cp437", "mac_roman")),
    (("cp1253", "iso8859-7", "cp737"), ("utf-8", "cp1252", "latin-1", "mac_roman", "cp1251")),
    (("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"), ("utf-8", "cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r", "cp866")),
    (("gb18030", "big5", "cp932", "euc_jp", "euc_kr"), ("utf-8", "cp1252", "latin-1", "mac_roman", "cp437")),
)
#: Bits of the bitmap of suspects: about 32 for each, 16 MB at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Hashes by which tokens are sorted out before they are joined: 8 MB at most.
HASHES = 1 << 20

FORMS = "token string, original string, chain string, place int, multi boolean, units int, trusted boolean"


@lru_cache(maxsize=64)
def _undefined(encoding: str) -> frozenset[int]:
    """Bytes that a one-byte encoding does not define."""
    out = set()
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out.add(b)
    return frozenset(out)


_WIDE = {"utf-8", "gb18030", "big5", "cp932", "euc_kr", "euc_jp"}


def misread(raws: list[bytes], encoding: str) -> list[list[str]]:
    """The texts that decoders make of each of these bytes; they differ in what they do with undefined bytes.

    All are decoded in one call, joined by line breaks, which no encoding here uses for anything else.
    """
    data, n = b"\n".join(raws), len(raws)
    try:
        texts = [data.decode(encoding)]
    except UnicodeDecodeError:
        texts = [data.decode(encoding, "replace"), data.decode(encoding, "ignore")]
        if encoding not in _WIDE and encoding != "ascii":
            gaps = _undefined(encoding)
            texts.append(codecs.charmap_decode(data, "strict", "".join(chr(b) if b in gaps else bytes([b]).decode(encoding) for b in range(256)))[0])
    columns = [t.split("\n") for t in texts]
    if any(len(c) != n for c in columns):  # a broken character took the line break with it
        columns = [[r.decode(encoding, how) for r in raws] for how in ("replace", "ignore")]
    return columns


def garbled_columns(words: list[str]) -> Iterator[tuple[str, bool, list[str], list[str]]]:
    """For each chain, in order: its name, whether it comes of UTF-8, words, and a garbled form of each."""

    def forms(chain: str, multi: bool, own: list[str], columns: list[list[str]]) -> Iterator[tuple[str, bool, list[str], list[str]]]:
        for k, column in enumerate(columns):
            if k:  # where the decoders agree, once is enough
                pairs = [(w, f) for w, f, first in zip(own, column, columns[0]) if f != first]
                yield chain, multi, [w for w, _ in pairs], [f for _, f in pairs]
            else:
                yield chain, multi, own, column

    raws = [w.encode() for w in words]
    for d in UTF8_READ_AS:
        yield from forms(f"utf-8>{d}", True, words, misread(raws, d))
    for d, again in UTF8_TWICE:
        for once in misread(raws, d):
            yield from forms(f"utf-8>{d}>utf-8>{again}", True, words, misread([x.encode() for x in once], again))
    letters = set().union(*words)
    for encodings, decodings in LEGACY:
        for e in encodings:
            known = {c for c in letters if _encodable(c, e)}
            own = [w for w in words if known.issuperset(w)]
            raws = [w.encode(e) for w in own]
            for d in decodings:
                if d != e and own:
                    yield from forms(f"{e}>{d}", False, own, misread(raws, d))


@lru_cache(maxsize=200_000)
def _encodable(c: str, encoding: str) -> bool:
    try:
        c.encode(encoding)
        return True
    except UnicodeEncodeError:
        return False


def with_lower(chain: str, word: str, form: str) -> Iterator[tuple[str, str]]:
    """The form and its lower case, with the chain of each, where they differ from the word and go beyond ASCII."""
    if form and form != word and not form.isascii():
        yield form, chain
        low = form.lower()
        if low != form and low != word:
            yield low, chain + "+lower"


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """Each garbled form of one word: its first chain, and whether it comes of UTF-8."""
    out: dict[str, tuple[str, bool]] = {}
    for chain, multi, words, forms in garbled_columns([word]):
        for w, form in zip(words, forms):
            for f, c in with_lower(chain, w, form):
                out.setdefault(f, (c, multi))
    return out


@lru_cache(maxsize=65_536)
def _kind(c: str) -> str:
    """Script of a letter, or its category."""
    category = unicodedata.category(c)
    if category[0] == "M":
        return "mark"
    if category[0] != "L":
        return "digit" if category == "Nd" else "joint" if c in "'’-.,/:_" else "other"
    name = unicodedata.name(c, "?").split()
    script = name[1] if name[0] in ("FULLWIDTH", "HALFWIDTH") and len(name) > 1 else name[0]
    return "HAN" if script.split("-")[0] in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else script


def natural(token: str) -> bool:
    """Whether a token is made like a word: letters of one script, in a usual pattern of case."""
    if len(token) == 1:
        return token != "�" and not "\x7f" < token < "\xa0"
    kinds = {_kind(c) for c in token} - {"mark", "digit", "joint"}
    if len(kinds) > 1 or "other" in kinds:
        return False
    letters = [c for c in token if c.isalpha()]
    rest = "".join(letters[1:])
    return rest == rest.lower() or token == token.upper()


_UNITS = re.compile("[\x80-\U0010ffff]+")


def read_back(token: str) -> tuple[str, str] | None:
    """The original and chain of a token whose runs beyond ASCII read as proper UTF-8 again."""
    for d in ("cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1251", "koi8-r", "iso8859-15", "iso8859-2", "cp1250", "cp1254"):
        text, rounds = token, 0
        while rounds < 2:
            gaps = _undefined(d)
            try:
                raw = b"".join(bytes([ord(c)]) if ord(c) in gaps else c.encode(d) for c in text)
                once = raw.decode()
            except UnicodeError:
                break
            text, rounds = once, rounds + 1
            if text.isascii() or natural(text):
                break
        if rounds and len(text) < len(token) and natural(text) and "�" not in text and not any("\x7f" < c < "\xa0" for c in text):
            return text, "utf-8>" + ">utf-8>".join([d] * rounds)
    return None


def judge(token: str, original: str, chain: str, multi: bool, units: int, trusted: bool) -> int:
    """How well a match is verified; 0 if it is not.

    Several characters for one, of UTF-8, hardly come about by chance, unless a single ideograph stands for a
    single letter. One character for one is believed in a token that is not made like a word, or in a longer
    word with several such characters and nothing else done to it; a lone character is not enough. Other matches
    with trusted words are left to their rows.
    """
    lone = len(token) == 1
    if multi:
        return 0 if lone or (len(original) == 1 and natural(token) and units < 2) else 3
    if lone or len(original) < 2:
        return 0
    if not natural(token):
        return 2
    return 1 if trusted and len(original) >= 4 and (units >= 2 or len(original) >= 5) and not chain.endswith("+lower") else 0


def script(word: str) -> str | None:
    """The one script of a word's letters; None if there are several or none."""
    found = {k for k in map(_kind, word) if k not in ("mark", "digit", "joint", "other")}
    return found.pop() if len(found) == 1 else None


def evidence(token: str, original: str | None, text: str) -> int:
    """What a text tells about a doubtful match: 2 is enough, 1 counts beside another of the same chain.

    2: the original has the script of most letters of the text's other words, and the token another script. A lone
    character counts for nothing, nor does a token in capitals where all is in capitals.
    """
    if original is None or len(token) == 1:
        return 0
    own = script(original)
    if own is not None and script(token) not in (None, own):
        others = [_kind(c) for w in re.split(r"[\t\n\x0b\x0c\r ]+", text) if w != token for c in w if c.isalpha()]
        if 2 * others.count(own) > len(others):
            return 2
    return 0 if token == token.upper() and text == text.upper() else 1


def _letters_beyond_ascii(text: Column) -> Column:
    return F.length(text) != F.octet_length(text)


def _tokens(texts: DataFrame, col: str, *keep: str) -> DataFrame:
    """Tokens beyond ASCII, each once for a row."""
    token = F.explode(F.array_distinct(F.split(F.col(col), "[\\t\\n\\x0B\\f\\r ]+")))
    narrow = texts.select(*keep, col).where(_letters_beyond_ascii(F.col(col)))
    return narrow.select(*keep, token.alias("token")).where(_letters_beyond_ascii(F.col("token")))


_CANONICAL = T.StructType([T.StructField("plain", T.StringType()), T.StructField("natural", T.BooleanType())])


def _undisguised(token: str) -> str:
    """The word that the token looks like; empty if that has only ASCII letters though the token is no word.

    Where what is invisible may be what misreading leaves, the token stands for itself.
    """
    if re.search("[\x80-\x9f�]|[\xc2-\xf4][\xa0\xad]", token):
        return token.lower()
    plain = canonical(token)
    return "" if plain.isascii() and not natural(token) else plain.lower()


@F.pandas_udf(_CANONICAL)
def _looked_at(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"plain": [_undisguised(t) for t in tokens], "natural": [natural(t) for t in tokens]})


def vocabulary(texts: DataFrame, clean: list[tuple[DataFrame, str]], col: str) -> tuple[DataFrame, DataFrame]:
    """(clean words, suspects): distinct tokens beyond ASCII.

    Words of the clean texts are trusted. Tokens of the searched texts that are made like words are words too,
    and suspects at the same time; what looks like a trusted word is no suspect.
    """
    parts = [_tokens(t, c).select("token") for t, c in clean]
    known = reduce(DataFrame.unionByName, parts).select(F.lower("token").alias("token")).distinct()
    known = known.withColumn("look", _looked_at("token")).select(F.col("token").alias("word"), F.coalesce(F.nullif("look.plain", F.lit("")), "token").alias("form"))
    known = hold(known)
    found = _tokens(texts, col).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # With n in what is asked, the join stays above the count, and tokens are looked at once each.
    counted = F.when(F.col("n") > 0, F.col("token"))
    looked = found.withColumn("look", _looked_at(counted)).where("n > 0 AND look.plain != ''").select("token", "look.plain", "look.natural")
    suspects = hold(looked.join(known.select("form"), looked.plain == known.form, "left_anti").select("token", "natural"))
    own = suspects.where("natural").select(F.col("token").alias("word"), F.lit(False).alias("trusted"))
    return known.select("word", F.lit(True).alias("trusted")).unionByName(own), suspects


def bitmap(tokens: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit for every token's hash, of so many bits as the tokens need. At most MOST_BITS/64 small rows reach the driver."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (32 * tokens.count()).bit_length()))
    at = F.xxhash64("token").bitwiseAND(bits - 1)
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    rows = tokens.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def _form_rows(bits, mask: int):
    """Forms of each word that the bitmap of suspects lets through."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bits.value
        for pdf in batches:
            trust = dict.fromkeys(pdf["word"], False) | dict.fromkeys(pdf["word"][pdf["trusted"]], True)
            out = []
            for place, (chain, multi, words, forms) in enumerate(garbled_columns(list(trust)) if trust else ()):
                for word, raw in zip(words, forms):
                    for form, name in with_lower(chain, word, raw):
                        at = xxhash.xxh64_intdigest(form.encode(), 42) & mask
                        if known[at >> 3] >> (at & 7) & 1:
                            out.append((form, word, name, place, multi, sum(not c.isascii() for c in word), trust[word]))
            yield pd.DataFrame(out, columns=["token", "original", "chain", "place", "multi", "units", "trusted"])

    return rows


@F.pandas_udf(T.IntegerType())
def _judged(
    token: pd.Series, original: pd.Series, chain: pd.Series, multi: pd.Series, units: pd.Series, trusted: pd.Series
) -> pd.Series:
    return pd.Series([judge(*x) for x in zip(token, original, chain, multi, units, trusted)], dtype="int32")


@F.pandas_udf(T.StringType())
def _traced(tokens: pd.Series) -> pd.Series:
    """The chain that a token's units tell of; ``lost`` where they are gone."""
    out = []
    for t in tokens:
        back = None if t is None or "�" in t or natural(t) else read_back(t)
        out.append("lost" if t is not None and "�" in t else back[1] if back else None)
    return pd.Series(out, dtype=object)


def matches(texts: DataFrame, clean: list[tuple[DataFrame, str]], col: str, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(suspects, their matches with forms of words, each with its weight). Matches are dear, so they are written to the shared folder."""
    words, suspects = vocabulary(texts, clean, col)
    spark = texts.sparkSession
    known = bitmap(suspects, bits)
    lets = spark.sparkContext.broadcast(known)
    # A fixed number of tasks: making the forms takes long for the few bytes that the words are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    forms = words.repartition(tasks, "word").mapInPandas(_form_rows(lets, 8 * len(known) - 1), FORMS)
    found = forms.join(suspects.select("token"), "token").withColumn("weight", _judged("token", "original", "chain", "multi", "units", "trusted"))
    return suspects, kept(found, "forms")


def _original() -> Column:
    """A form with losses may come of several words; of none for certain."""
    return F.when(~F.col("token").contains("�") | (F.col("least") == F.col("most")), F.col("best.original")).alias("original")


def garbled_tokens(suspects: DataFrame, found: DataFrame) -> DataFrame:
    """(token, original, chain, origin) of every token garbled wherever it stands; original is null where several words, or none, fit."""
    rank = F.struct("weight", F.col("trusted").cast("int"), F.negative("place"), "original", "chain")
    best = (
        found.where("weight > 0")
        .groupBy("token")
        .agg(F.max(rank).alias("best"), F.min("original").alias("least"), F.max("original").alias("most"))
        .select("token", _original(), F.col("best.chain").alias("chain"))
    )
    told = suspects.join(best, "token", "left")
    told = told.withColumn("trace", _traced(F.when(F.col("chain").isNull() & ~F.col("natural"), F.col("token"))))
    origin = F.when(F.col("chain").isNotNull(), F.lit("table")).otherwise(F.lit("trace"))
    return told.select("token", "original", F.coalesce("chain", "trace").alias("chain"), origin.alias("origin")).where("chain IS NOT NULL")


@F.pandas_udf(T.IntegerType())
def _evidence(token: pd.Series, original: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([evidence(*x) for x in zip(token, original, text)], dtype="int32")


def spots(texts: DataFrame, tokens: DataFrame, found: DataFrame, id_col: str, col: str) -> DataFrame:
    """Every place of a garbled token, or of one that its row is asked about, with what may be said of it.

    ``told`` marks results. Others are matches to weigh: those of told tokens (without an original), and doubtful ones.
    Most places are sorted out before the shuffle, by a part of the token's hash: at most HASHES numbers are broadcast.
    A row goes along only with doubtful tokens; it is known by its id and text, as a null id may be that of many rows.
    """
    base = F.regexp_replace("chain", r"[+]lower$", "").alias("base")
    none = [F.lit(None).cast("string").alias(c) for c in ("original", "chain")]
    told = tokens.select("token", "original", "chain", F.lit(0).alias("place"), F.lit("").alias("base"), "origin")
    sure = found.where("weight > 0").select("token", *none, F.lit(0).alias("place"), base, F.lit("sure").alias("origin"))
    doubtful = found.where("weight = 0 AND trusted").join(tokens.select("token"), "token", "left_anti")
    doubtful = doubtful.select("token", "original", "chain", "place", base, F.lit("row").alias("origin"))
    asked = hold(told.unionByName(sure).unionByName(doubtful).distinct())
    part = F.xxhash64("token").bitwiseAND(HASHES - 1)
    parts = F.broadcast(asked.groupBy(part.alias("part")).agg(F.bool_or(F.col("origin") == "row").alias("doubt")))
    rows = texts.select(F.col(id_col).alias("row_id"), F.xxhash64(col).alias("row_hash"), F.col(col).alias("text"), F.col(col).alias("words"))
    places = _tokens(rows, "words", "row_id", "row_hash", "text").withColumn("part", part).join(parts, "part")
    narrow = places.select("row_id", "row_hash", "token", F.when(F.col("doubt"), F.col("text")).alias("text"))
    return narrow.join(asked, "token").withColumn("text", F.when(F.col("origin") == "row", F.col("text")))


def row_verified(places: DataFrame) -> DataFrame:
    """(row_id, row_hash, token, original, chain, origin) of tokens that only their row shows to be garbled.

    Asked are matches with trusted words that have no weight of their own, of tokens that are not told yet. They are
    believed in a row whose other words are mostly of the original's script while the token is not, and in a row where
    another token, verified without the row or by its script, has a match of the same chain, or two doubtful ones have.
    """
    weighed = places.where("base != ''").withColumn("evidence", _evidence("token", "original", "text")).drop("text")
    row_chain = W.partitionBy("row_id", "row_hash", "base")
    vouched = F.max(F.col("original").isNull() | (F.col("evidence") == 2)).over(row_chain)
    several = F.size(F.collect_set(F.when(F.col("evidence") > 0, F.col("token"))).over(row_chain)) > 1
    agreed = weighed.withColumn("agrees", vouched | (several & (F.col("evidence") > 0))).where("original IS NOT NULL AND (agrees OR evidence = 2)")
    rank = F.struct(F.col("agrees").cast("int") + F.col("evidence"), F.negative("place"), "original", "chain")
    best = agreed.groupBy("row_id", "row_hash", "token").agg(F.max(rank).alias("best"), F.min("original").alias("least"), F.max("original").alias("most"))
    return best.select("row_id", "token", _original(), F.col("best.chain").alias("chain"), F.lit("row").alias("origin"))


def garbled_entries(texts: DataFrame, clean: list[tuple[DataFrame, str]], id_col: str, col: str) -> DataFrame:
    """(id, token, original, chain, origin) of every garbled token of every row."""
    texts = texts.select(id_col, col)
    suspects, found = matches(texts, clean, col)
    places = hold(spots(texts, hold(garbled_tokens(suspects, found)), found, id_col, col))
    told = places.where("base = ''").select("row_id", "token", "original", "chain", "origin")
    return told.unionByName(row_verified(places)).withColumnRenamed("row_id", id_col)


@F.pandas_udf(T.StringType())
def _substituted(texts: pd.Series, originals: pd.Series) -> pd.Series:
    out = []
    for text, pairs in zip(texts, originals):
        known = {p["token"]: p["original"] for p in pairs} if pairs is not None else {}
        out.append(re.sub(r"[^\t\n\x0b\x0c\r ]+", lambda m: known.get(m.group(), m.group()), text))
    return pd.Series(out)


def restored(texts: DataFrame, clean: list[tuple[DataFrame, str]], id_col: str, col: str) -> DataFrame:
    """(id, text, restored, whole) of each affected row; whole: whether every garbled token got its original.

    The id must be unique. A row's pairs are bounded by its own text.
    """
    hits = garbled_entries(texts, clean, id_col, col)
    pairs = hits.groupBy(id_col).agg(
        F.collect_set(F.when(F.col("original").isNotNull(), F.struct("token", "original"))).alias("pairs"),
        F.bool_and(F.col("original").isNotNull()).alias("whole"),
    )
    pairs = pairs.withColumnRenamed(id_col, "hit_id")
    rows = texts.select(F.col(id_col).alias("row_id"), F.col(col).alias("text"))
    rows = rows.join(pairs, rows.row_id.eqNullSafe(pairs.hit_id))
    return rows.select(F.col("row_id").alias(id_col), "text", _substituted("text", "pairs").alias("restored"), "whole")
