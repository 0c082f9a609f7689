"""Values of delimited columns inside a text, such as a pasted class list.

The first line whose cells name a wanted column (in any spelling of case, accents, blanks, `_` and `-`)
is the header; its delimiter is the commonest of comma, semicolon and tab. Lines below it belong to the
table until one has too few cells; lines that begin with `#` are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.textops import fold_text
from ..sources.delimited import cells

# Header spellings, with rule number, type, confidence and priority.
COLUMNS = [
    (19, "bsn", 0.995, 102, {"bsn", "burgerservicenummer"}),
    (20, "date", 0.99, 105, {"dob", "dateofbirth", "geboortedatum"}),
    (34, "detail", 0.98, 121, {"studentid", "studentnumber", "pupilid", "leerlingnummer", "studentnummer", "employeeid", "staffid", "passportnumber", "personeelsnummer"}),
]
_MENTION = r"(?iu)b[ _-]*s[ _-]*n|burger|d[ _-]*o[ _-]*b|date|geboorte|student|pupil|leerling|employee|staff|passport|personeel"
_LINES = re.compile(r"[^\r\n]+")
KIND = "array<struct<start:int,end:int,value:string,type:string,layer:string,confidence:double,priority:int,rule_seq:int>>"


def canonical(value: str) -> str:
    return re.sub(r"[\s_-]", "", fold_text(value))


def _real(day: str, month: str, year: str) -> bool:
    d, m, y = int(day), int(month), int(year)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return 1000 <= y <= 2999 and 1 <= m <= 12 and 1 <= d <= last[m - 1]


def is_birth_date(value: str) -> bool:
    parts = re.split("[/.-]", value)
    if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts):
        return False
    if len(parts[0]) == 4:
        return _real(parts[2], parts[1], parts[0])
    year = parts[2]
    if len(year) == 2:
        year = ("20" if int(year) <= 49 else "19") + year
    return len(year) == 4 and (_real(parts[0], parts[1], year) or _real(parts[1], parts[0], year))


def is_bsn(value: str) -> bool:
    only = re.sub(r"[^0-9]", "", value)
    if len(only) not in (8, 9) or not only.strip("0"):
        return False
    nine = only.zfill(9)
    return (sum(int(c) * (9 - i) for i, c in enumerate(nine[:8])) - int(nine[8])) % 11 == 0


def is_code(value: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9/_-]{3,19}", value) and re.search("[0-9]", value))


_TESTS: dict[int, Callable[[str], bool]] = {19: is_bsn, 20: is_birth_date, 34: is_code}


def column_values(text: str, aliases: set[str], test: Callable[[str], bool]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of the valid cells below the first header that names one of the aliases."""
    lines = [(m.start(), m[0]) for m in _LINES.finditer(text)]
    for i, (_, line) in enumerate(lines):
        delimiter = max(",;\t", key=line.count)
        if delimiter not in line:
            continue
        wanted = [k for k, c in enumerate(cells(line, delimiter)) if canonical(c.value) in aliases]
        if not wanted:
            continue
        for at, row in lines[i + 1 :]:
            if row.lstrip().startswith("#"):
                continue
            found = cells(row, delimiter)
            if len(found) <= wanted[0]:
                return
            cell = found[wanted[0]]
            begin = row.find(cell.value, cell.start, cell.end) if cell.value and test(cell.value) else -1
            if begin >= 0:
                yield at + begin, at + begin + len(cell.value), cell.value
        return


def column_candidates(text: Column) -> Column:
    """Candidate spans of all column rules; texts that name no wanted header are not sent to Python."""

    @F.pandas_udf(KIND)
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for body in texts:
            rows = []
            for seq, kind, confidence, priority, aliases in COLUMNS if body else ():
                rows += [{"start": a, "end": b, "value": v, "type": kind, "layer": "regex", "confidence": confidence, "priority": priority, "rule_seq": seq} for a, b, v in column_values(body, aliases, _TESTS[seq])]
            out.append(rows)
        return pd.Series(out, dtype=object)

    return found(F.when(text.rlike("[0-9]") & text.rlike("[,;\t]") & text.rlike("[\r\n]") & text.rlike(_MENTION), text))
