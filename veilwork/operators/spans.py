"""Span algebra inside a row: four different merges, none of which needs a shuffle.

Candidates of a document are an array; sorting and folding it is linear in its spans, and documents
stay where they are. Touching spans never merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.textops import bound, with_cuts
from ..plans.rules import TYPES

FINAL = "array<struct<start:int,end:int,type:string,layer:string,confidence:double>>"
MERGED = "array<struct<start:int,end:int,type:string>>"
RANGES = "array<struct<start:int,end:int>>"


def _fold(spans: Column, kind: str, made: Callable[[Column, Column, Column, Column], Column], typed: bool = True, growing: bool = False) -> Column:
    """made(first span, end, mixed, confidence) of each union of sorted spans, as a list of kind.

    A span that begins at or after the end so far begins a union; others belong to it. mixed: a member's type is not the
    first's; confidence: the members' largest. growing: behind the first, only members that move the end count.
    Unions are folded into a text that names them: it grows by copying one block, where a list copies element by element.
    """
    nothing = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("mixed"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("out"))

    def told(done: Column) -> Column:
        return F.concat(done["out"], F.concat_ws(" ", done["first"].cast("string"), done["end"].cast("string"), done["mixed"].cast("string"), done["confidence"].cast("string")), F.lit(";"))

    def step(done: Column, s: Column) -> Column:
        apart = (done["first"] < 0) | (s["start"] >= done["end"])
        counts = s["end"] > done["end"] if growing else F.lit(True)
        more = [F.lit(None).cast("string").alias("type"), F.lit(False).alias("mixed"), F.lit(None).cast("double").alias("confidence")]
        if typed:
            differs = ~F.coalesce(s["type"] == done["type"], F.lit(False))
            more = [F.when(apart, s["type"]).otherwise(done["type"]).alias("type"), F.when(apart, False).otherwise(done["mixed"] | (counts & differs)).alias("mixed"), more[2]]
        if growing:
            more[2] = F.when(apart, s["confidence"]).when(counts, F.greatest(done["confidence"], s["confidence"])).otherwise(done["confidence"]).alias("confidence")
        return F.struct(
            (done["i"] + 1).alias("i"),
            F.when(apart, done["i"]).otherwise(done["first"]).alias("first"),
            F.when(apart, s["end"]).otherwise(F.greatest(done["end"], s["end"])).alias("end"),
            *more,
            F.when(apart & (done["first"] >= 0), told(done)).otherwise(done["out"]).alias("out"),
        )

    def unions(sorted_spans: Column) -> Column:
        names = F.aggregate(sorted_spans, nothing, step, lambda done: F.when(done["first"] < 0, "").otherwise(told(done)))
        part = lambda x, k: F.get(F.split(x, " "), F.lit(k))
        one = lambda x: made(F.get(sorted_spans, part(x, 0).cast("int")), part(x, 1).cast("int"), part(x, 2).cast("boolean"), part(x, 3).cast("double"))
        return F.transform(F.filter(F.split(names, ";"), lambda x: x != ""), one)

    return bound(spans, unions).cast(kind)


def _with_values(text: Column, spans: Column) -> Column:
    shown = lambda s, cut: F.struct(s["start"].alias("start"), s["end"].alias("end"), cut(s["start"], s["end"] - s["start"]).alias("value"), s["type"].alias("type"), s["layer"].alias("layer"), s["confidence"].alias("confidence"))
    return bound(spans, lambda found: with_cuts(text, F.size(found), lambda cut: F.transform(found, lambda s: shown(s, cut))))


def resolve_overlaps(text: Column, candidates: Column) -> Column:
    """The final spans of candidates: by start, longest first, then priority, then rule order.

    A contained candidate is ignored. A crossing one extends the span before it: the union becomes
    `detail` if the types differ, keeps the first layer and takes the larger confidence.
    """
    valid = F.filter(candidates, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))
    keyed = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), (-s["priority"]).alias("p"), s["rule_seq"].alias("q"), s["end"].alias("end"), s["type"].alias("type"), s["layer"].alias("layer"), s["confidence"].alias("confidence")))
    union = lambda first, end, mixed, confidence: F.struct(first["start"], end, F.when(mixed, "detail").otherwise(first["type"]), first["layer"], confidence)
    folded = _fold(F.array_sort(keyed), FINAL, union, growing=True)
    return _with_values(text, folded)


def _sorted_valid(text: Column, spans: Column, *more: str) -> Column:
    valid = bound(F.length(text), lambda size: F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= size) & (s["start"] == F.floor(s["start"])) & (s["end"] == F.floor(s["end"]))))
    return F.array_sort(F.transform(valid, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("e"), s["end"].cast("int").alias("end"), *(s[m].alias(m) for m in more))))


def known_type(kind: Column) -> Column:
    return F.when(kind.isin(*TYPES), kind).otherwise("detail")


def merge_confirmed(text: Column, spans: Column) -> Column:
    """Unions of overlapping confirmed spans; `detail` if any member's type differs, contained members included."""
    typed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), known_type(s["type"]).alias("type")))
    return _fold(_sorted_valid(text, typed, "type"), MERGED, lambda first, end, mixed, _: F.struct(first["start"], end, F.when(mixed, "detail").otherwise(first["type"])))


def merge_ranges(text: Column, spans: Column) -> Column:
    """Unions of overlapping spans, whatever their types."""
    return _fold(_sorted_valid(text, spans), RANGES, lambda first, end, *_: F.struct(first["start"], end), typed=False)


def apply_manual(text: Column, spans: Column, occurrences: Column, kind: str) -> Column:
    """Adds manual occurrences to final spans: each grows over the spans it overlaps and its type wins."""
    same = "array<struct<start:int,e:int,end:int,type:string,layer:string,confidence:double,manual:boolean>>"
    shape = lambda s, *rest: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["end"].alias("end"), *rest)
    own = F.transform(spans, lambda s: shape(s, s["type"].alias("type"), s["layer"].alias("layer"), s["confidence"].alias("confidence"), F.lit(False).alias("manual"))).cast(same)
    added = F.transform(occurrences, lambda s: shape(s, F.lit(kind).alias("type"), F.lit("manual").alias("layer"), F.lit(1.0).alias("confidence"), F.lit(True).alias("manual"))).cast(same)
    union = lambda first, end, several, _: F.struct(first["start"], end, F.when(several, kind).otherwise(first["shown"]), F.when(several, "manual").otherwise(first["layer"]), F.when(several, 1.0).otherwise(first["confidence"]), several | first["manual"])
    #: A union's members all differ in type, so that any second one makes it manual.
    folded = _fold(F.transform(F.array_sort(F.concat(own, added)), lambda s: F.struct(*(s[n].alias(n) for n in ("start", "end", "layer", "confidence", "manual")), s["type"].alias("shown"), F.lit(None).cast("string").alias("type"))), same.replace("e:int,end", "end"), union)
    return _with_values(text, folded)
