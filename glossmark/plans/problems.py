"""Queries of the general data problems: attribute rows into wide tables (2), rows that fail to parse (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmark.operators import badrows, wide
from glossmark.sources.tables import table


KNOWN = ("Lm", "LmOov", "Pruned", "Domain")


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    texts = wide.text_rows(table(spark, folder, "nbest"), "entry_id", "feats")
    rows = wide.attribute_rows(table(spark, folder, "feat_rows"), "entry_id", "feat", "val", "loaded_at")
    return texts.unionByName(rows), wide.kinds_of(table(spark, folder, "feat_defs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide.faulty_attributes(wide.entity_maps(*_features(spark, folder), every=False), "entry_id")


def _wide_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    raw, kinds = _features(spark, folder)
    kinds = kinds | wide.other_names(raw, kinds)
    return wide.entity_maps(raw, kinds), kinds


def p2_wide(spark: SparkSession, folder: str) -> DataFrame:
    maps, kinds = _wide_maps(spark, folder)
    return wide.typed_columns(maps, kinds, "entry_id")


def p2_wide_rest(spark: SparkSession, folder: str) -> DataFrame:
    """What p2_wide has no column for: maps of the names beyond wide.MAX_COLUMNS."""
    return wide.rest_maps(_wide_maps(spark, folder)[0], "entry_id")


def p2_wide_defined(spark: SparkSession, folder: str) -> DataFrame:
    """A typed column for every definition, one row per entry; the values of names without one are left out."""
    raw, kinds = _features(spark, folder)
    return wide.typed_columns(wide.entity_maps(raw, kinds, tuple(kinds)), kinds, "entry_id").drop("faults")


def p2_wide_known(spark: SparkSession, folder: str) -> DataFrame:
    """A few typed columns of every entry, in a fixed schema."""
    raw, kinds = _features(spark, folder)
    kept = {k: kinds[k] for k in KNOWN}
    return wide.typed_columns(wide.entity_maps(raw, kept, KNOWN), kept, "entry_id").drop("faults")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.faulty_lines(badrows.parse_lines(table(spark, folder, "nbest_raw")))


def p4_valid(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.valid_entries(badrows.parse_lines(table(spark, folder, "nbest_raw")))


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p2_wide_rest": p2_wide_rest, "p2_wide_defined": p2_wide_defined, "p2_wide_known": p2_wide_known, "p4_found": p4_found, "p4_valid": p4_valid}

_PAIRS = r"""
tok AS (SELECT entry_id, unnest(string_split_regex(feats, '[ \t]+')) AS t FROM nbest),
pairs AS (
  SELECT entry_id, substr(t, 1, instr(t, '=') - 1) AS feat, substr(t, instr(t, '=') + 1) AS val, 1 AS first, NULL::TIMESTAMP AS loaded
  FROM tok WHERE instr(t, '=') > 0
  UNION ALL SELECT entry_id, feat, val, 0, loaded_at FROM feat_rows WHERE feat IS NOT NULL),
vals AS (
  SELECT p.entry_id, p.feat, first, loaded, coalesce(d.value_type, 'string') AS kind, regexp_replace(val, '^\s+|\s+$', '', 'g') AS v
  FROM pairs p LEFT JOIN feat_defs d ON d.feat = p.feat WHERE val IS NOT NULL),
typed AS (
  SELECT entry_id, feat, first, loaded, v,
    CASE WHEN v = '' THEN NULL
      WHEN kind = 'double' THEN CASE WHEN regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
        AND isfinite(TRY_CAST(v AS DOUBLE)) THEN CAST(TRY_CAST(v AS DOUBLE) + 0 AS VARCHAR) END
      WHEN kind = 'int' THEN CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN
        CASE WHEN ltrim(ltrim(v, '+-'), '0') = '' THEN '0' ELSE (CASE WHEN v[1] = '-' THEN '-' ELSE '' END) || ltrim(ltrim(v, '+-'), '0') END END
      WHEN kind = 'boolean' THEN CASE WHEN lower(v) IN ('true', 'false') THEN lower(v) END
      ELSE v END AS canon
  FROM vals)"""

_PARSED = r"""
a AS (SELECT line_id, replace(line, ' ||| ', chr(31)) AS s FROM nbest_raw),
b AS (SELECT line_id, s,
  regexp_full_match(s, '(?s)("([^"]|"")*"|([^"\x1f][^\x1f]*)?)(\x1f("([^"]|"")*"|([^"\x1f][^\x1f]*)?))*') AS sound,
  string_split(regexp_replace(s, '(^|\x1f)"(?:[^"]|"")*"', '\1' || chr(30), 'g'), chr(31)) AS parts,
  replace(regexp_extract(s, '^"((?:[^"]|"")*)"', 1), '""', '"') AS first_quoted,
  replace(regexp_extract(s, '\x1f"((?:[^"]|"")*)"$', 1), '""', '"') AS last_quoted FROM a),
c AS (SELECT line_id, CASE WHEN s IS NULL OR regexp_full_match(s, '\s*') THEN 'field_count' WHEN NOT sound THEN 'quoting'
    WHEN len(parts) <> 4 THEN 'field_count' END AS broken,
  trim(CASE WHEN parts[1] = chr(30) THEN first_quoted ELSE parts[1] END, E' \t') AS sid,
  trim(CASE WHEN parts[-1] = chr(30) THEN last_quoted ELSE parts[-1] END, E' \t') AS tot, parts FROM b),
d AS (SELECT *, NOT regexp_full_match(sid, '[0-9]+') OR length(ltrim(sid, '0')) > 10 OR TRY_CAST(sid AS HUGEINT) > 2147483647 AS bad_sid,
  NOT regexp_full_match(tot, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
    OR coalesce(abs(TRY_CAST(tot AS DOUBLE)), 'inf'::DOUBLE) >= 3.4028235677973366e38 AS bad_tot FROM c)"""


# The definitions of the table, for SQL with a column of each.
_DEFINED = {
    "Beam": "string", "Deriv": "string", "Distortion": "double", "Domain": "string", "Forced": "boolean", "ForestSize": "int", "GlueRules": "int",
    "HypLen": "int", "LexBwd": "double", "LexFwd": "double", "Lm": "double", "LmOov": "int", "NnScore": "double", "PassThroughs": "int",
    "PhraseBwd": "double", "PhraseFwd": "double", "Pruned": "boolean", "ReoMono": "double", "ReoSwap": "double", "RuleCount": "int",
    "Shard_Id": "string", "WordPen": "double", "crf.Content": "int", "crf.Stop": "int",
}


def _typed_sql(names: tuple[str, ...]) -> str:
    """One row per entry of both tables, with a typed column of each name."""
    kinds = {"double": "DOUBLE", "int": "BIGINT", "boolean": "BOOLEAN", "string": "VARCHAR"}
    columns = ", ".join(f"""TRY_CAST(max(value) FILTER (WHERE feat = '{n}') AS {kinds[_DEFINED[n]]}) AS "{wide.column_name(n)}\"""" for n in names)
    return f"""WITH {_PAIRS},
won AS (SELECT entry_id, feat, arg_max(canon, (first, coalesce(loaded, TIMESTAMP '0001-01-01'), canon)) FILTER (WHERE canon IS NOT NULL) AS value
  FROM typed GROUP BY entry_id, feat),
every AS (SELECT entry_id FROM nbest UNION SELECT entry_id FROM feat_rows)
SELECT e.entry_id, {columns} FROM every e LEFT JOIN won w ON w.entry_id IS NOT DISTINCT FROM e.entry_id GROUP BY e.entry_id"""


def _field(k: int) -> str:
    """Field k, from the quoted texts if it is one of them."""
    nth = f"len(list_filter(parts[1:{k}], lambda x: x = chr(30)))"
    return f"""CASE WHEN parts[{k}] = chr(30) THEN replace(replace(quoted[{nth}], '""', '"'), chr(31), ' ||| ') ELSE parts[{k}] END"""


SQL = {
    "p2_found": f"WITH {_PAIRS} SELECT entry_id, feat FROM typed GROUP BY entry_id, feat "
    "HAVING count(*) > count(canon) OR min(canon) <> max(canon)",
    "p2_wide_defined": _typed_sql(tuple(_DEFINED)),
    "p2_wide_known": _typed_sql(KNOWN),
    "p4_valid": f"""WITH {_PARSED}, q AS (SELECT d.*, regexp_extract_all(b.s, '(?:^|\\x1f)"((?:[^"]|"")*)"', 1) AS quoted FROM d JOIN b USING (line_id)
  WHERE broken IS NULL AND NOT bad_sid AND NOT bad_tot)
SELECT line_id, sid::INT AS sent_id, {_field(2)} AS hyp, {_field(3)} AS feats, tot::FLOAT AS total FROM q""",
    "p4_found": f"""WITH {_PARSED}
SELECT line_id, broken AS fault FROM d WHERE broken IS NOT NULL
UNION ALL SELECT line_id, 'sent_id' FROM d WHERE broken IS NULL AND bad_sid
UNION ALL SELECT line_id, 'total' FROM d WHERE broken IS NULL AND bad_tot""",
}
