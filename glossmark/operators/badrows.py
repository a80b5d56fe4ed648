"""Separate n-best lines that fail to parse from those that load, with every reason.

A record is ``sentId ||| hyp ||| feats ||| total``. Records of files are assembled quote-aware (``sources.text.
quoted_records``): a quoted field may go on over line breaks. Rows of a table are records as they are. Each partition reads
its records with the strict reader of Python's ``csv`` module, whose structural exceptions become the fault
``quoting``, and only then runs the typed constructors of the fields.

Defined results: a null, empty or blank line has the fault ``field_count``; an empty ``hyp`` or ``feats``
is valid; lines that are equal are judged each on its own; a null id stays null; an empty table gives an
empty result; other columns of the input, whatever their names, are not looked at. Lines may be of any length.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.session import spread

SEPARATOR = " ||| "
FIELDS = 4
MAX_INT = 2147483647
#: Numbers from here on round to infinity as a 32-bit float.
FLOAT_LIMIT = 3.4028235677973366e38

SCHEMA = "line_id bigint, line string, sent_id int, hyp string, feats string, total float, faults array<string>"

_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_QUOTED = re.compile('"(?:[^"]+|"")*+"')
_DIGITS = re.compile(r"[0-9]+")


def _unused(line: str, count: int) -> list[str]:
    """Characters that the line does not contain, to stand for separators and line breaks."""
    found: list[str] = []
    code = 0xE000
    for c in ("\x1f", "\x1e", "\x1d"):
        if c not in line:
            found.append(c)
    while len(found) < count:
        if chr(code) not in line:
            found.append(chr(code))
        code += 1
    return found


def read_fields(line: str) -> list[str]:
    """The fields of one record, unquoted; raises csv.Error if its quoting is broken."""
    sep, cr, lf = _unused(line, 3)[:3]
    record = line.replace(SEPARATOR, sep).replace("\r", cr).replace("\n", lf)
    rows = list(csv.reader([record], delimiter=sep, quotechar='"', doublequote=True, strict=True))
    fields = rows[0] if rows else [""]
    return [f.replace(sep, SEPARATOR).replace(cr, "\r").replace(lf, "\n") for f in fields]


def quote_open(record: str) -> bool:
    """Whether the record ends within a quoted field."""
    at = 0
    while True:
        if record.startswith('"', at):
            closed = _QUOTED.match(record, at)
            if closed is None:
                return True
            at = closed.end()
            if not record.startswith(SEPARATOR, at):
                return False  # at the end, or broken
        else:
            at = record.find(SEPARATOR, at)
            if at < 0:
                return False
        at += len(SEPARATOR)


def assembled(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(number, text) of the records of a few lines: the first one is joined with those that its open quote needs.

    If the quote is never closed, or what is joined is broken, every line stands for itself.
    """
    if len(lines) > 1 and quote_open(lines[0][1]):
        record = lines[0][1]
        for k, (_, line) in enumerate(lines[1:], 1):
            record += "\n" + line
            if '"' in line and not quote_open(record):
                try:
                    read_fields(record)
                except csv.Error:
                    break
                return [(lines[0][0], record), *lines[k + 1 :]]
    return lines


def make_sent_id(text: str) -> int:
    s = text.strip(" \t")
    if not _DIGITS.fullmatch(s):
        raise ValueError("not ASCII digits")
    s = s.lstrip("0") or "0"
    if len(s) > 10 or int(s) > MAX_INT:
        raise ValueError("out of range")
    return int(s)


def make_total(text: str) -> float:
    s = text.strip(" \t")
    if not _NUMBER.fullmatch(s):
        raise ValueError("not a decimal number")
    x = float(s)
    if abs(x) >= FLOAT_LIMIT:
        raise ValueError("out of range")
    return x


def parse_record(line: str | None) -> tuple:
    """(sent_id, hyp, feats, total, faults) of one line."""
    if line is None or not line.strip():
        return None, None, None, None, ["field_count"]
    try:
        fields = read_fields(line)
    except csv.Error:
        return None, None, None, None, ["quoting"]
    if len(fields) != FIELDS:
        return None, None, None, None, ["field_count"]
    faults = []
    sent_id = total = None
    try:
        sent_id = make_sent_id(fields[0])
    except ValueError:
        faults.append("sent_id")
    try:
        total = make_total(fields[3])
    except ValueError:
        faults.append("total")
    return sent_id, fields[1], fields[2], total, faults


def _parse_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)
    for pdf in batches:
        got = [parse_record(x if isinstance(x, str) else None) for x in pdf["line"]]
        out = pd.DataFrame(got, columns=["sent_id", "hyp", "feats", "total", "faults"], dtype=object)
        out["sent_id"] = out["sent_id"].astype("Int32")
        out["total"] = out["total"].astype("Float32")
        out.insert(0, "line_id", pdf["line_id"])
        out.insert(1, "line", pdf["line"])
        yield out


def parse_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """One row per line with its fields and its faults (an empty list if it is valid). No shuffle of its own."""
    narrow = lines.select(
        F.col(f"`{id_col}`").cast("bigint").alias("line_id"), F.col(f"`{line_col}`").cast("string").alias("line")
    )
    return spread(narrow).mapInPandas(_parse_partition, SCHEMA)


def valid_entries(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("faults") == 0).select("line_id", "sent_id", "hyp", "feats", "total")


def faulty_lines(parsed: DataFrame) -> DataFrame:
    """One row per faulty line and fault."""
    return parsed.select("line_id", F.explode("faults").alias("fault"))
