"""Delimited text and name lists."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.textops import fold_text

# Header spellings and limits of a name list.
FIRST = {"first", "firstname", "given", "givenname", "forename", "voornaam"}
LAST = {"last", "lastname", "surname", "familyname", "achternaam"}
PREFIX = {"prefix", "surnameprefix", "tussenvoegsel"}
FULL = {"name", "fullname", "studentname", "pupilname", "naam", "volledigenaam"}
MOST_RECORDS, MOST_FIELD, MOST_PARTS, MOST_TOTAL = 2000, 256, 32, 200_000

_QUOTED = re.compile(r'\s*"((?:[^"]|"")*)(?:"|$)')


class Cell(NamedTuple):
    value: str
    start: int
    end: int


class ListError(ValueError):
    """A name list beyond its limits."""

    code, category, retryable = "csv_complex", "validation", False


def cells(line: str, delimiter: str) -> list[Cell]:
    """The cells of one line: quotes count at a cell's begin only, doubled quotes stand for one, values are trimmed."""
    out, at, n = [], 0, len(line)
    while True:
        begin, value = at, ""
        if line[at : at + 1] == '"':
            quoted = _QUOTED.match(line, at)
            value, at = quoted[1].replace('""', '"'), quoted.end()
        stop = line.find(delimiter, at)
        stop = n if stop < 0 else stop
        out.append(Cell((value + line[at:stop]).strip(), begin, stop))
        if stop == n:
            return out
        at = stop + 1


def records(text: str, delimiter: str) -> list[list[str]]:
    """Rows of a whole file; a quoted cell may hold line breaks; rows of empty cells are left out."""
    rows, row, at, n = [], [], 0, len(text)
    ends = re.compile(f"[{re.escape(delimiter)}\r\n]")
    while True:
        value = ""
        if text[at : at + 1] == '"':
            quoted = re.compile(r'"((?:[^"]|"")*)(?:"|$)').match(text, at)
            value, at = quoted[1].replace('""', '"'), quoted.end()
        hit = ends.search(text, at)
        stop = hit.start() if hit else n
        row.append((value + text[at:stop]).strip())
        if not hit or hit[0] != delimiter:
            if any(row):
                rows.append(row)
            row = []
        if not hit:
            return rows
        at = stop + (2 if text[stop : stop + 2] == "\r\n" else 1)


def delimiter_of(text: str) -> str:
    """A semicolon if, outside quotes, there are more of them than commas."""
    bare = re.sub(r'"(?:[^"]|"")*(?:"|$)', "", text)
    return ";" if bare.count(";") > bare.count(",") else ","


def check_names(rows: list[tuple[str, str]]) -> None:
    """Raises ListError when a list exceeds its limits."""
    total = 0
    for first, last in rows:
        total += len(first) + len(last)
        parts = len(re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", f"{first} {last}"))
        if len(rows) > MOST_RECORDS or max(len(first), len(last)) > MOST_FIELD or total > MOST_TOTAL or parts > MOST_PARTS:
            raise ListError("csv_complex")


def parse_names(text: str | None) -> list[tuple[str, str]]:
    """(first, last) records of a name list with or without a header; exact repeats are left out."""
    text = (text or "").removeprefix("﻿")
    rows = records(text, delimiter_of(text)) if text.strip() else []
    heads = [[re.sub(r"[\s_-]", "", fold_text(c)) for c in row] for row in rows[:8]]
    where = next((i for i, h in enumerate(heads) if {*h} & (FIRST | LAST | FULL)), -1)
    place = lambda names: next((k for k, c in enumerate(heads[where]) if c in names), -1) if where >= 0 else -1
    first, last, prefix, full = place(FIRST), place(LAST), place(PREFIX), place(FULL)
    whole = full >= 0 and first < 0 and last < 0
    first = max(first, 0)
    if last < 0:
        last = 1 if first == 0 else 0
    out: dict[tuple[str, str], None] = {}
    for row in rows[where + 1 :]:
        cell = lambda k, row=row: row[k] if 0 <= k < len(row) else ""
        a, b = (cell(full), "") if whole else (cell(first), cell(last))
        b = f"{cell(prefix)} {b}".strip() if cell(prefix) else b
        if a or b:
            out[unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)] = None
    check_names([*out])
    return [*out]


def name_records(lists: DataFrame, key: str, text: str = "text") -> DataFrame:
    """lists (key, text of a whole list) -> key, first, last, error; a row a record, or one row with an error code for a list beyond its limits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch[key], batch[text], strict=True):
                try:
                    rows += [(k, a, b, None) for a, b in parse_names(body)]
                except ListError as x:
                    rows.append((k, None, None, x.code))
            yield pd.DataFrame(rows, columns=[key, "first", "last", "error"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.select(key, text).mapInPandas(run, f"{key} {kind}, first string, last string, error string")
