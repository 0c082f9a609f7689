"""Span algebra on rows: the merges of `spans` for tables with one span a row.

A document's spans are sorted once; a running maximum of the ends before a span tells whether it begins an island or
grows the one before it, a running count of beginnings numbers the islands, and a grouping makes one row of each.
That is linear in a document's spans, where the fold over an array copies what it has at each span, and the window
spills, so a document with a million spans needs no more memory than others.

Invalid spans (a null or negative start, an end at or before it) are left out; touching spans do not merge; documents
are told apart by `key`, whose null is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .replace import REMOVED
from .rewrite import rewritten
from .spans import known_type


def islands(spans: DataFrame, key: str, *more: str) -> DataFrame:
    """spans (key, start, end, ...) with `island`, and `grows`: whether a span begins or widens its island."""
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), *more)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("__before").isNull() | (F.col("start") >= F.col("__before"))
    rows = spans.where("start >= 0 and end > start").withColumn("__before", before)
    rows = rows.withColumn("grows", fresh | (F.col("end") > F.col("__before")))
    return rows.withColumn("island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__before")


def resolved(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """candidates (key, start, end, type, layer, confidence, priority, rule_seq) -> key, start, end, type, layer, confidence.

    As `spans.resolve_overlaps`: by start, longest first, then priority, then rule order; contained candidates are ignored,
    crossing ones widen the span before them, which becomes `detail` if the types differ.
    """
    rows = islands(candidates, key, F.desc("priority"), "rule_seq", "type", "layer", "confidence").where("grows")
    order = F.struct("start", -F.col("end"), -F.col("priority"), "rule_seq", "type", "layer", "confidence")
    kinds = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("detail")
    out = rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), kinds.alias("type"), F.min_by("layer", order).alias("layer"), F.max("confidence").alias("confidence"))
    return out.drop("island")


def confirmed(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, start, end, type) -> the unions of overlapping ones; `detail` if any member's type differs. As `spans.merge_confirmed`."""
    rows = islands(spans.withColumn("type", known_type(F.col("type"))), key)
    kinds = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("detail")
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), kinds.alias("type")).drop("island")


def ranges(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, start, end) -> the unions of overlapping ones. As `spans.merge_ranges`."""
    return islands(spans, key).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def redacted(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `redacted`: each union of a document's spans (key, start, end) becomes one marker.

    Spans that end behind the text are left out. A document's unions are an array only at the end, when its text is written.
    """
    sizes = docs.select(F.col(key).alias("__key"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("__size"))
    inside = spans.join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("end") <= F.col("__size")), "left_semi")
    marks = ranges(inside, key).groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(REMOVED).alias("mark")))).alias("__marks"))
    both = docs.join(marks, F.col(key).eqNullSafe(F.col("__key")), "left")
    return both.withColumn("redacted", rewritten(F.coalesce(F.col(text), F.lit("")), F.col("__marks"))).drop("__key", "__marks")
