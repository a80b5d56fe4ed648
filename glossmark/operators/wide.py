"""Entity, attribute, value rows into one row per entity with typed columns.

Pairs come from two places: ``name=value`` tokens in a text column, and rows. Rows are shuffled once, by entity and as
they are; behind the shuffle the tokens are split, the pairs resolved per (entity, attribute), the resolved pairs of an
entity gathered into one map, and the known names projected from it into typed columns. Values that fail their cast, and
names with two different typed values, are retained. The pairs of an entity with more than HOT rows are resolved with a
mergeable aggregate before they are shuffled, so that no task gets its rows.
Names beyond MAX_COLUMNS get no column; they stay in the maps of the parts after 0, which ``rest_maps`` returns.

Defined results: blanks around a value are ignored; a null value, and a token without ``=``, give nothing; an
empty value fits no type; a name without a definition is a ``string``; names compare exactly. Of several
different typed values that from the tokens wins, then the latest loaded, then the greatest in text order.
Repeated rows change nothing. Rows of a null entity form one entity of their own. Other columns of the inputs
are not looked at. An entity without any pair has a row of nulls. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"double": "double", "int": "bigint", "boolean": "boolean", "string": "string"}
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: More definitions than this are refused: each is a column of the result.
MAX_COLUMNS = 5000
#: Rows of an entity that one task resolves; of an entity with more, each task resolves its own before the shuffle.
HOT = 200_000
#: Names without a definition are spread over so many rows of an entity.
PARTS = 64


def text_rows(df: DataFrame, entity: str, text: str) -> DataFrame:
    """Rows with ``name=value`` tokens, as (entity, text, feat, val, loaded)."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("feat", "string"), ("val", "string"), ("loaded", "timestamp_ntz"))]
    return df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{text}`").alias("text"), *none)


def attribute_rows(df: DataFrame, entity: str, name: str, value: str, loaded: str) -> DataFrame:
    """Rows of an attribute each, as (entity, text, feat, val, loaded)."""
    return df.select(
        F.col(f"`{entity}`").alias("entity"), F.lit(None).cast("string").alias("text"), F.col(f"`{name}`").alias("feat"),
        F.col(f"`{value}`").alias("val"), F.col(f"`{loaded}`").cast("timestamp_ntz").alias("loaded"),
    )


def pairs_of(raw: DataFrame, every: bool = False) -> DataFrame:
    """(entity, feat, val, loaded, first) of each row's pairs; with ``every`` also (entity, null) of each row."""
    tokens = F.filter(F.split("text", r"[ \t]+"), lambda t: F.instr(t, "=") > 0)
    none = F.array(F.lit(None).cast("string"))
    each = raw.select("entity", "feat", "val", "loaded", F.explode(F.when(F.col("text").isNull(), none).otherwise(tokens)).alias("token"))
    if every:
        own = F.concat(F.array(F.lit("=")), F.when(F.col("text").isNull(), none).otherwise(tokens))  # a token without a name
        each = raw.select("entity", "feat", "val", "loaded", F.posexplode(own).alias("at", "token"))
        named = F.col("at") > 0
        each = each.select("entity", *[F.when(named, F.col(c)).alias(c) for c in ("feat", "val", "loaded", "token")])
    at = F.instr("token", "=")
    of_token = F.col("token").isNotNull()
    return each.select(
        "entity",
        F.when(of_token, F.col("token").substr(F.lit(1), at - 1)).otherwise(F.col("feat")).alias("feat"),
        F.when(of_token, F.col("token").substr(at + 1, F.length("token"))).otherwise(F.col("val")).alias("val"),
        "loaded",
        of_token.cast("int").alias("first"),
    )


def canonical(kind: Column, value: Column) -> Column:
    """One text for all spellings of a typed value; null if the value does not fit the type."""
    number = value.try_cast("double")
    finite = value.rlike(NUMBER) & (F.abs(number) < F.lit(float("inf")))
    digits = F.regexp_replace(value, r"^([+-]?)0*(?=[0-9])", "$1")
    whole = F.when(F.regexp_replace(digits, "^[+-]", "") == "0", F.lit("0")).otherwise(F.regexp_replace(digits, "^[+]", ""))
    return (
        F.when(value == "", F.lit(None))
        .when(kind == "double", F.when(finite, (number + F.lit(0.0)).cast("string")))
        .when(kind == "int", F.when(value.rlike("^[+-]?[0-9]+$"), whole))
        .when(kind == "boolean", F.when(F.lower(value).isin("true", "false"), F.lower(value)))
        .otherwise(value)
    )


def resolve_pairs(pairs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row per (entity, feat): the winning typed value, a value that failed, and whether values differ.

    min and max of the canonical texts tell whether there are two, so no set of values is gathered. Pairs without a name
    or value become one row without a name.
    """
    spark = pairs.sparkSession
    defs = F.broadcast(spark.createDataFrame([(k, v) for k, v in kinds.items()], "feat string, kind string"))  # at most MAX_COLUMNS
    usable = F.col("feat").isNotNull() & F.col("val").isNotNull()
    named = pairs.withColumn("feat", F.when(usable, F.col("feat"))).join(defs, "feat", "left")
    trimmed = named.withColumn("val", F.when(usable, F.regexp_replace("val", r"^\s+|\s+$", "")))
    typed = trimmed.withColumn("canon", canonical(F.coalesce("kind", F.lit("string")), F.col("val")))
    return typed.groupBy("entity", "feat").agg(
        F.max(F.when(F.col("canon").isNotNull(), F.struct("first", "loaded", "canon")))["canon"].alias("value"),
        F.min(F.when(F.col("canon").isNull(), F.col("val"))).alias("failed"),
        (F.min("canon") != F.max("canon")).alias("differs"),
    )


def column_name(feat: str) -> str:
    """``crf.Content`` becomes ``feat_crf_Content``."""
    return "feat_" + re.sub(r"\W", "_", feat)


def kinds_of(defs: DataFrame, name: str = "feat", kind: str = "value_type") -> dict[str, str]:
    """The definitions, at most MAX_COLUMNS; of repeated ones the first type in text order."""
    rows = (
        defs.where(F.col(name).isNotNull())
        .groupBy(F.col(name).alias("n"))
        .agg(F.min(F.coalesce(F.when(F.col(kind).isin(*TYPES), F.col(kind)), F.lit("string"))).alias("k"))
        .orderBy("n")
        .limit(MAX_COLUMNS + 1)
        .collect()
    )
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} definitions")
    return {r["n"]: r["k"] for r in rows}


def other_names(raw: DataFrame, kinds: dict[str, str]) -> dict[str, str]:
    """The names in use that have no definition, as strings; at most what MAX_COLUMNS leaves, the first in text order.

    The values of all others are in ``rest_maps``.
    """
    room = MAX_COLUMNS - len(kinds)
    names = pairs_of(raw).where("feat IS NOT NULL AND val IS NOT NULL").select("feat").distinct()
    if kinds:
        names = names.where(~F.col("feat").isin(*kinds))
    found = [r[0] for r in names.orderBy("feat").limit(room + 1).collect()]
    return {n: "string" for n in found[:room]}


def entity_maps(raw: DataFrame, kinds: dict[str, str], named: tuple[str, ...] | None = None, every: bool = True) -> DataFrame:
    """(entity, part, attrs, faults): maps of an entity's resolved names, their values and the texts that failed.

    The row of part 0 has the names in ``kinds``, so it is bounded by their number; with ``every``, each entity has one, be its
    maps empty. Other names are spread over parts by their hash, so that an entity with very many of them is never gathered into
    one row. With ``named``, other names than these are left out.
    """
    counted = raw.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = counted.select(F.col("entity").alias("hot"))  # entities with HOT rows or more each, so few
    ordinary, same = raw, F.col("entity").eqNullSafe(F.col("hot"))
    busy = not hot.isEmpty()
    if busy:
        ordinary = raw.join(F.broadcast(hot), same, "left_anti")
    maps = _gathered(ordinary.repartition("entity"), kinds, named, every)
    if busy:
        maps = maps.unionByName(_gathered(raw.join(F.broadcast(hot), same, "left_semi"), kinds, named, every))
    return maps


def _gathered(raw: DataFrame, kinds: dict[str, str], named: tuple[str, ...] | None, every: bool) -> DataFrame:
    pairs = pairs_of(raw, every)
    if named is not None:
        pairs = pairs.withColumn("feat", F.when(F.col("feat").isin(*named), F.col("feat")))
    resolved = resolve_pairs(pairs, kinds)
    part = (1 + F.pmod(F.xxhash64("feat"), F.lit(PARTS))).cast("int")
    part = F.when(F.col("feat").isin(*kinds), 0).otherwise(part) if kinds else part
    part = F.when(F.col("feat").isNull(), 0).otherwise(part)
    faulty = F.col("failed").isNotNull() | F.coalesce(F.col("differs"), F.lit(False))
    return (
        resolved.withColumn("part", part)
        .groupBy("entity", "part")
        .agg(
            F.map_from_entries(F.collect_list(F.when(F.col("feat").isNotNull(), F.struct("feat", "value")))).alias("attrs"),
            F.map_from_entries(F.collect_list(F.when(faulty, F.struct("feat", "failed")))).alias("faults"),
        )
    )


def typed_columns(maps: DataFrame, kinds: dict[str, str], entity: str) -> DataFrame:
    """One row per entity with a column of the right type per name in ``kinds``.

    ``faults`` retains what no column can hold: the text of a value that failed its type, and null for a
    name with two different typed values. An integer beyond 64 bits fits its type but not its column; it is
    retained in ``faults`` too.
    """
    taken: dict[str, str] = {}
    for feat in kinds:
        c = column_name(feat)
        while c.lower() in {t.lower() for t in (*taken, entity, "faults")}:
            c += "_"
        taken[c] = feat
    big = F.map_filter("attrs", lambda k, v: k.isin(*[f for f in kinds if kinds[f] == "int"]) & v.try_cast("bigint").isNull())
    return maps.where(F.col("part") == 0).select(
        F.col("entity").alias(entity),
        *[F.try_element_at("attrs", F.lit(f)).try_cast(TYPES[kinds[f]]).alias(c) for c, f in taken.items()],
        F.map_concat("faults", F.map_filter(big, lambda k, v: ~F.map_contains_key("faults", k))).alias("faults"),
    )


def rest_maps(maps: DataFrame, entity: str) -> DataFrame:
    """(entity, part, attrs, faults) of the names that have no column: what ``typed_columns`` leaves out."""
    return maps.where(F.col("part") > 0).select(F.col("entity").alias(entity), "part", "attrs", "faults")


def faulty_attributes(maps: DataFrame, entity: str) -> DataFrame:
    """Each name to which an entity gives a value that fails its type, or two different typed values."""
    return maps.select(F.col("entity").alias(entity), F.explode(F.map_keys("faults")).alias("feat"))
