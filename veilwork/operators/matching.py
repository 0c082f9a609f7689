"""Regular-expression matches with their places, in one row and without a UDF.

One pass of `regexp_replace` sets marks before and behind each match (and behind a copy of its group); splitting
at the marks gives the gaps and the matches, and running lengths of both give each match's place. The marks are
noncharacters of Unicode; where a text holds such a one, another noncharacter, which no pattern tells from it,
stands in for it while matching, and values are cut from the text itself. Texts without a match are scanned once
(`rlike` makes no copy), and not even that if a cheaper guard fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.textops import bound

FOUND = "array<struct<start:int,end:int,value:string>>"
PLACED = "array<struct<at:int,m:string,g:string>>"
BEGIN, GROUP, STOP, STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def none_found(kind: str = FOUND) -> Column:
    return F.array().cast(kind)


def last_place(whole: Column, part: Column) -> Column:
    """0-based place of the last occurrence of part in whole."""
    return F.length(whole) - F.length(part) - (F.instr(F.reverse(whole), F.reverse(part)) - 1)


def matches(text: Column, pattern: str, group: int = 0, trim: Callable[[Column], Column] | None = None, test: Callable[[Column], Column] | None = None, guard: Column | None = None) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, left to right.

    group: the value is this group, at its last place inside the match. trim: shortens a value from
    the right. test: keeps a value; it sees the trimmed one. Scanning goes on after the whole match.
    """
    marked = F.regexp_replace(F.translate(text, BEGIN + GROUP + STOP, STAND_IN * 3), F.lit(pattern), F.lit(f"{BEGIN}$0{GROUP}{f'${group}' if group else ''}{STOP}"))

    def step(done: Column, x: Column) -> Column:
        """x: match, mark, group, mark, the gap behind it. Places are folded into a text, which grows by copying one block."""
        return F.struct((done["at"] + F.length(x) - F.length(of_group(x)) - 2).alias("at"), F.concat(done["out"], done["at"].cast("string"), F.lit(",")).alias("out"))

    def of_group(x: Column) -> Column:
        return F.substring_index(F.substring_index(x, STOP, 1), GROUP, -1)

    def placed(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.lit("").alias("out"))
        places = F.split(F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), start, step)["out"], ",")
        found = F.zip_with(places, F.slice(parts, F.lit(2), F.size(parts) - 1), lambda at, x: F.struct(at.alias("at"), F.substring_index(x, GROUP, 1).alias("m"), of_group(x).alias("g")))
        return F.filter(found, lambda x: x["m"].isNotNull()).cast(PLACED)

    def cut(x: Column) -> Column:
        """The span of a match's value, as it stands in the text."""
        begin = x["at"] + (last_place(x["m"], x["g"]) if group else F.lit(0))
        seen = x["g"] if group else x["m"]
        value = F.when(seen.contains(STAND_IN), F.substring(text, begin + 1, F.length(seen))).otherwise(seen)
        return bound(trim(value) if trim else value, lambda v: F.struct(begin.alias("start"), (begin + F.length(v)).alias("end"), v.alias("value")))

    spans = F.filter(F.transform(bound(F.split(marked, BEGIN), placed), cut), lambda s: (F.length(s["value"]) > 0) & (F.coalesce(test(s["value"]), F.lit(False)) if test else F.lit(True)))
    there = text.rlike(pattern)
    return F.when((guard & there) if guard is not None else there, spans).otherwise(none_found())
