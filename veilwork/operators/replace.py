"""Removal, reversible codes and restoring, as expressions over one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.textops import EDGE, bound, with_cuts
from .spans import merge_confirmed, merge_ranges

# Marker, labels, token shapes and reasons.
REMOVED = "[REMOVED]"
LABELS = {"name": "PERSON", "email": "EMAIL", "phone": "PHONE", "iban": "IBAN", "bsn": "BSN", "address": "ADDRESS", "date": "DATE", "postcode": "POSTCODE", "url": "URL", "ip": "IP", "detail": "DETAIL", "filename": "FILE"}
SOURCE_TOKEN = r"(?i)\[\[[A-Z][A-Z0-9_]*_\d{3,}\]\]"
LIKE_TOKEN = r"\[{1,3}[A-Za-z][A-Za-z0-9 _-]{0,60}_\d{1,9}\]{1,3}"
GOOD_TOKEN = r"^\[\[[A-Za-z][A-Za-z0-9_]*_\d{3,}\]\]$"
ANY_LABEL = "(?:" + "|".join(LABELS.values()) + ")"
CORE_TOKEN = rf"(?i)\[*{EDGE}{ANY_LABEL}_\d{{1,9}}{EDGE}\]*"
KNOWN_TOKEN = rf"(?i)(?<!\[)\[\[{ANY_LABEL}_\d{{3,}}\]\](?!\])"
MISSING = "Placeholder missing from reply; check the source and intended meaning"
UNKNOWN = "Unknown placeholder; no matching session mapping"
MALFORMED = "Malformed placeholder; left unchanged"


def substitute(text: Column, spans: Column, mark) -> Column:
    """The text with each of its ascending, disjoint spans replaced by mark(span)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def done(spans: Column, cut: Callable[[Column, Column], Column]) -> Column:
        step = lambda d, s: F.struct(F.concat(d["out"], cut(d["at"], s["start"] - d["at"]), mark(s)).alias("out"), s["end"].alias("at"))
        return F.aggregate(spans, start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))

    return bound(spans, lambda own: with_cuts(text, F.size(own), lambda cut: done(own, cut)))


def redact(text: Column, spans: Column) -> Column:
    """Each union of overlapping spans becomes one marker; the same for every type."""
    text = F.coalesce(text, F.lit(""))
    return substitute(text, merge_ranges(text, spans), lambda s: F.lit(REMOVED))


def label_of(kind: Column) -> Column:
    out = F.lit("DETAIL")
    for k, label in LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def token(label: Column, number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("[["), label, F.lit("_"), F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text), F.lit("]]"))


def reserved_tokens(text: Column) -> Column:
    """Lower-cased token-shaped literals of a source text, which codes must not collide with."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SOURCE_TOKEN), F.lit(0)), lambda t: F.lower(t)))


def free_number(label: Column, k: Column, reserved: Column) -> Column:
    """The k-th number whose token of this label is not reserved."""
    numbers = F.sequence(F.lit(1), (k + F.size(reserved)).cast("int"))
    return F.element_at(F.filter(numbers, lambda n: ~F.array_contains(reserved, F.lower(token(label, n)))), k.cast("int"))


def code_table(text: Column, spans: Column) -> Column:
    """array<struct<original, pseudonym, type, ord>> of a document that is its own session, in order of first occurrence."""
    text = F.coalesce(text, F.lit(""))
    found = F.transform(merge_confirmed(text, spans), lambda s: F.struct(s["type"].alias("type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("original")))

    def entry(values: Column, reserved: Column, v: Column, i: Column) -> Column:
        k = F.size(F.filter(F.slice(values, F.lit(1), i + 1), lambda x: x["type"] == v["type"]))
        label = label_of(v["type"])
        return F.struct(v["original"].alias("original"), token(label, free_number(label, k, reserved)).alias("pseudonym"), v["type"].alias("type"), (i + 1).alias("ord"))

    held = F.struct(F.array_distinct(found).alias("values"), reserved_tokens(text).alias("reserved"))
    return bound(held, lambda h: F.transform(h["values"], lambda v, i: entry(h["values"], h["reserved"], v, i)))


def anonymize(text: Column, spans: Column, codes: Column) -> Column:
    """The text with each union of spans replaced by its code from `codes` (original, pseudonym, type)."""
    text = F.coalesce(text, F.lit(""))
    merged = F.transform(merge_confirmed(text, spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(s["type"], F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("key")))
    of = lambda s: F.get(F.filter(codes, lambda c: (c["type"] == s["key"]["type"]) & (c["original"] == s["key"]["col2"])), F.lit(0))["pseudonym"]
    return substitute(text, merged, of)


def restore(reply: Column, codes: Column) -> Column:
    """The reply with every complete known token (in any case) replaced by its original."""
    reply = F.coalesce(reply, F.lit(""))
    known = F.transform(codes, lambda c: F.struct(F.lower(c["pseudonym"]).alias("t"), c["original"].alias("o")))
    found = F.regexp_extract_all(reply, F.lit(KNOWN_TOKEN), F.lit(0))
    gaps = F.split(reply, KNOWN_TOKEN, -1)
    back = lambda m: F.coalesce(F.get(F.filter(known, lambda k: k["t"] == F.lower(m)), F.lit(0))["o"], m)
    return F.array_join(F.concat(F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m")), lambda x: F.concat(x["g"], back(x["m"]))), F.slice(gaps, F.lit(-1), F.lit(1))), "")


def restore_flags(reply: Column, codes: Column, reserved: Column) -> Column:
    """array<struct<pseudonym, reason>>: known tokens that are missing, tokens unknown or malformed; first of equals kept."""
    reply = F.coalesce(reply, F.lit(""))
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    flag = lambda x, reason: F.struct(x.alias("pseudonym"), reason.alias("reason"))
    seen = lower(F.regexp_extract_all(reply, F.lit(KNOWN_TOKEN), F.lit(0)))
    missing = F.transform(F.filter(codes, lambda c: ~F.array_contains(seen, F.lower(c["pseudonym"]))), lambda c: flag(c["pseudonym"], F.lit(MISSING)))
    known = lower(F.transform(codes, lambda c: c["pseudonym"]))
    like = F.filter(F.regexp_extract_all(reply, F.lit(LIKE_TOKEN), F.lit(0)), lambda t: ~F.array_contains(known, F.lower(t)) & ~F.array_contains(reserved, F.lower(t)))
    odd = F.transform(like, lambda t: flag(t, F.when(t.rlike(GOOD_TOKEN), UNKNOWN).otherwise(MALFORMED)))
    core = F.filter(F.regexp_extract_all(reply, F.lit(CORE_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^\[\[.*\]\]$"))
    return F.array_distinct(F.concat(missing, odd, F.transform(core, lambda t: flag(t, F.lit(MALFORMED)))))
