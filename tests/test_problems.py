"""Lines that fail to parse, and wide tables from attribute rows."""

import csv

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmark.operators import badrows, wide
from glossmark.plans import problems
from glossmark.sources import text as source

LINES = {
    "0 ||| a ||| f=1 ||| -1.5": [],
    " 007\t ||| ||| f ||| +.5e3 ": ["field_count"],
    " 007\t |||  ||| f ||| +.5e3 ": [],
    '1 ||| "a ||| ""b""" |||  ||| 1': [],
    '1 ||| "a ||| b ||| f ||| 1': ["quoting"],
    '1 ||| "a"x ||| f ||| 1': ["quoting"],
    '1 ||| a "b" c ||| f ||| 1': [],
    '"1" ||| a ||| f ||| "2"': [],
    "x ||| a ||| f ||| y": ["sent_id", "total"],
    "2147483647 ||| a ||| f ||| 3.4e38": [],
    "2147483648 ||| a ||| f ||| 3.5e38": ["sent_id", "total"],
    "-1 ||| a ||| f ||| NaN": ["sent_id", "total"],
    "١ ||| a ||| f ||| 1": ["sent_id"],
    "1 ||| a ||| f": ["field_count"],
    "1 ||| a ||| f ||| 1 ||| ": ["field_count"],
    "1 || a ||| f ||| 1": ["field_count"],
    "": ["field_count"],
    " \t ": ["field_count"],
    "1 ||| a\nb\rc \x1f\x1e ||| f ||| 1": [],
    "1 ||| " + "long " * 60_000 + " ||| f ||| 1": [],
}


def test_lines(spark):
    rows = [(i, line, "x") for i, line in enumerate(LINES)] + [(900, None, "x"), (None, "1 ||| a", "x"), (0, next(iter(LINES)), "x")]
    parsed = badrows.parse_lines(spark.createDataFrame(rows, "line_id long, line string, faults string")).collect()
    assert len(parsed) == len(rows)
    for p in parsed:
        assert list(p.faults) == (LINES[p.line] if p.line in LINES else ["field_count"]), p.line
    quoted = next(p for p in parsed if p.line and '""b""' in p.line)
    assert (quoted.sent_id, quoted.hyp, quoted.feats, quoted.total) == (1, 'a ||| "b"', "", 1.0)
    broken = next(p for p in parsed if p.line and "\r" in p.line)
    assert broken.hyp == "a\nb\rc \x1f\x1e"
    empty = spark.createDataFrame([], "line_id long, line string")
    assert badrows.faulty_lines(badrows.parse_lines(empty)).collect() == []


RECORDS = [
    '0 ||| "a', 'b ""c"" ||| d" ||| f=1 ||| -1.5', "1 ||| plain ||| f ||| 2", '2 ||| "never closed ||| f ||| 1', "3 ||| after ||| f ||| 1", '4 ||| x ||| "f', "", 'g" ||| 7',
    "stray line", '5 ||| "broken', 'end"x ||| f ||| 1', '6 ||| a "b" c ||| f ||| 1', '7 ||| "open at the end',
]
JOINED = {
    0: ("a\nb \"c\" ||| d", []), 2: ("plain", []), 3: (None, ["quoting"]), 4: ("after", []), 5: ("x", []), 8: (None, ["field_count"]), 9: (None, ["quoting"]),
    10: (None, ["field_count"]), 11: ('a "b" c', []), 12: (None, ["quoting"]),
}


@pytest.mark.parametrize("split", [None, 40, 90])
def test_records_over_lines(spark, tmp_path, split):
    """A quoted field goes on over line breaks, also where the file is split; a quote that is never closed costs its line only."""
    (tmp_path / "raw").write_text("\n".join(RECORDS) + "\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = source.quoted_records(spark, str(tmp_path / "raw"))
        got = {r.line_id: (r.hyp, list(r.faults)) for r in badrows.parse_lines(records, "line_no").collect()}
        many = tmp_path / "many"
        many.write_text("".join(f'{i} ||| "text {i}\nmore" ||| f ||| 1\n' if i % 3 else f"{i} ||| text ||| f ||| 1\n" for i in range(300)))
        parsed = badrows.parse_lines(source.quoted_records(spark, str(many)), "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == JOINED
    assert sorted((r.sent_id, r.hyp) for r in parsed) == [(i, f"text {i}\nmore" if i % 3 else "text") for i in range(300)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', "a", " ||| ", " ", "x\n"]), max_size=9))
def test_open_quotes(parts):
    """A record is open where the strict reader runs into its end within quotes."""
    text = "".join(parts)
    try:
        badrows.read_fields(text)
        assert not badrows.quote_open(text)
    except csv.Error as e:
        assert badrows.quote_open(text) == ("unexpected end of data" in str(e))


@pytest.fixture(scope="module")
def pieces(spark):
    defs = spark.createDataFrame([("D", "double"), ("I", "int"), ("B", "boolean"), ("S", "string"), ("a.b", "int")], "feat string, value_type string")
    tokens = spark.createDataFrame(
        [(1, "D=1e3\tI=+07 B=TRUE  S=x=y"), (2, None), (3, ""), (4, "D= I=1.0 B=yes S= U=u"), (5, "D=1 D=1.0 I=1 I=2 noequals"), (6, "D=1e999 I=99999999999999999999")],
        "entry_id long, feats string",
    )
    rows = spark.createDataFrame(
        [
            (1, "D", " 1000 ", None), (1, "I", "7", None), (2, "a.b", "3", None), (2, "a.b", " 4", None), (2, "U", None, None), (2, "U", "v", None),
            (7, "S", " ", None), (7, None, "x", None), (None, "I", "5", None), (8, "D", "-0.0", None), (8, "D", "0", None), (2, "U", "v", None),
        ],
        "entry_id long, feat string, val string, loaded_at timestamp_ntz",
    )
    return defs, wide.text_rows(tokens, "entry_id", "feats").unionByName(wide.attribute_rows(rows, "entry_id", "feat", "val", "loaded_at"))


def test_faults(pieces):
    defs, raw = pieces
    got = wide.faulty_attributes(wide.entity_maps(raw, wide.kinds_of(defs)), "entry_id")
    assert sorted(map(tuple, got.collect())) == [(2, "a.b"), (4, "B"), (4, "D"), (4, "I"), (4, "S"), (5, "I"), (6, "D"), (7, "S")]


@pytest.mark.parametrize("hot", [200_000, 3])
def test_wide(pieces, spark, monkeypatch, hot):
    """Entities are resolved alike behind the shuffle and before it."""
    monkeypatch.setattr(wide, "HOT", hot)
    defs, raw = pieces
    kinds = wide.kinds_of(defs)
    kinds |= wide.other_names(raw, kinds)
    out = wide.typed_columns(wide.entity_maps(raw, kinds), kinds, "entry_id").collect()
    got = {r.entry_id: r for r in out}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, None} and len(out) == 9
    assert (got[1].feat_D, got[1].feat_I, got[1].feat_B, got[1].feat_S) == (1000.0, 7, True, "x=y")
    assert got[2].feat_U == "v" and got[2].feat_a_b in (3, 4) and got[2].faults == {"a.b": None}
    assert got[3].feat_D is None and got[3].faults == {}
    assert got[4].faults == {"D": "", "I": "1.0", "B": "yes", "S": ""} and got[4].feat_U == "u"
    assert got[6].feat_I is None and set(got[6].faults) == {"D", "I"} and got[8].feat_D == 0.0
    assert wide.typed_columns(wide.entity_maps(raw.limit(0), kinds), kinds, "entry_id").collect() == []


def test_hot_entity(spark):
    """An entity with very many names is spread over rows; its known names stay in one."""
    rows = spark.range(3000).select(F.lit(1).alias("e"), F.concat(F.lit("n"), F.col("id")).alias("f"), F.lit("v").alias("v"), F.lit(None).cast("timestamp_ntz").alias("t"))
    maps = wide.entity_maps(wide.attribute_rows(rows, "e", "f", "v", "t"), {"n0": "string"})
    sizes = [r[0] for r in maps.select(F.size("attrs")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200


def test_entry_without_features(spark, tmp_path):
    """Every entry has one row, with features or without, with the names of a fixed schema or others."""
    nbest = [(1, "Lm=1.5 X=a"), (2, None), (3, ""), (4, "X=b"), (1, "Lm=1.5")]
    rows = [(5, "X", "c", None), (6, "X", None, None), (7, None, "x", None), (2, "Pruned", "true", None)]
    defs = [("Lm", "double"), ("LmOov", "int"), ("Pruned", "boolean"), ("Domain", "string")]
    spark.createDataFrame(nbest, "entry_id long, feats string").write.parquet(f"{tmp_path}/nbest.parquet")
    spark.createDataFrame(rows, "entry_id long, feat string, val string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/feat_rows.parquet")
    spark.createDataFrame(defs, "feat string, value_type string").write.parquet(f"{tmp_path}/feat_defs.parquet")
    for query in (problems.p2_wide, problems.p2_wide_known, problems.p2_wide_defined):
        got = query(spark, str(tmp_path)).collect()
        assert sorted(r.entry_id for r in got) == [1, 2, 3, 4, 5, 6, 7], query.__name__
        by_id = {r.entry_id: r for r in got}
        assert by_id[1].feat_Lm == 1.5 and by_id[2].feat_Pruned is True and by_id[3].feat_Lm is None
    assert {r.entry_id: (r.feat_X, r.faults) for r in problems.p2_wide(spark, str(tmp_path)).collect()} == {
        1: ("a", {}), 2: (None, {}), 3: (None, {}), 4: ("b", {}), 5: ("c", {}), 6: (None, {}), 7: (None, {}),
    }


def test_more_names_than_columns(spark, tmp_path, monkeypatch):
    """Every pair comes out, in a column or beside the columns."""
    monkeypatch.setattr(wide, "MAX_COLUMNS", 3)
    nbest = [(i, f"D={i} n{i % 7}=v{i} m{i}=") for i in range(20)] + [(50, "n6=only")]
    spark.createDataFrame(nbest, "entry_id long, feats string").write.parquet(f"{tmp_path}/nbest.parquet")
    spark.createDataFrame([], "entry_id long, feat string, val string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/feat_rows.parquet")
    spark.createDataFrame([("D", "double")], "feat string, value_type string").write.parquet(f"{tmp_path}/feat_defs.parquet")
    table = problems.p2_wide(spark, str(tmp_path))
    assert len(table.columns) == 5
    wide_rows, rest = table.collect(), problems.p2_wide_rest(spark, str(tmp_path)).collect()
    assert sorted(r.entry_id for r in wide_rows) == [*range(20), 50]
    attrs = {(r.entry_id, k): v for r in rest for k, v in r.attrs.items() if v is not None}
    attrs |= {(r.entry_id, c.removeprefix("feat_")): v for r in wide_rows for c, v in r.asDict().items() if c.startswith("feat_n") and v is not None}
    assert attrs == {(i, f"n{i % 7}"): f"v{i}" for i in range(20)} | {(50, "n6"): "only"}
    faults = {(r.entry_id, k) for r in [*wide_rows, *rest] for k in r.faults}
    assert faults == {(i, f"m{i}") for i in range(20)}
