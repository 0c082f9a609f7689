"""Recall and false positives of spans against annotations.

Spans and places meet in bins of BIN code points, so that the join is by equal keys: a span lies in each bin that it
touches, a place in the bin of its first character, and a document with many spans has many bins and no pairs of
all spans with all places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def occurrences(notes: DataFrame) -> DataFrame:
    """notes (doc_id, text, value, type, ...) -> doc_id, value, type, start, ...: every place of each distinct annotation.

    Places may overlap; an annotation that the text does not hold has one row with a null start.
    """
    more = [c for c in notes.columns if c not in ("doc_id", "text", "value", "type")]
    notes = notes.where("value <> ''").dropDuplicates(["doc_id", "value", "type"])
    # The gaps between cuts at each place where the value begins: a lookahead takes no letters, so places may overlap.
    gaps = F.split("text", F.concat(F.lit(r"(?=\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")), -1)
    ends = F.aggregate(gaps, F.array(F.lit(0)), lambda done, g: F.concat(done, F.array(F.element_at(done, -1) + F.length(g))))
    places = F.filter(ends, lambda i: F.substring(F.col("text"), i + 1, F.length("value")) == F.col("value"))
    return notes.select("doc_id", "value", "type", F.explode_outer(F.array_distinct(places)).alias("start"), *more)


def _fits(kind: Column, found: Column, strict: bool) -> Column:
    return (kind == found) if strict else ((kind == found) | (found == "detail"))


def covered(places: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """places (doc_id, value, type, start, ...) with `rule`: the least rule among the spans that cover the place and fit its type, null if none does; spans have doc_id, start, end, type and rule."""
    d = spans.select(F.col("doc_id").alias("d_doc"), F.col("start").alias("d_start"), F.col("end").alias("d_end"), F.col("type").alias("d_type"), F.col("rule").alias("d_rule")).where("d_start >= 0 and d_end > d_start")
    d = d.withColumn("bin", F.explode(F.sequence(F.expr(f"d_start div {BIN}"), F.expr(f"(d_end - 1) div {BIN}"))))
    rows = places.withColumn("__id", F.struct("doc_id", "value", "type", "start"))
    inside = (F.col("d_start") <= F.col("start")) & (F.col("d_end") >= F.col("start") + F.length("value"))
    met = rows.withColumn("__bin", F.expr(f"start div {BIN}")).join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("__bin") == F.col("bin")) & _fits(F.col("type"), F.col("d_type"), strict) & inside)
    hits = met.groupBy(F.col("__id").alias("__hit")).agg(F.min(F.coalesce("d_rule", F.lit(""))).alias("rule"))
    return rows.join(hits, F.col("__id") == F.col("__hit"), "left").drop("__id", "__hit")


def unfounded(spans: DataFrame, notes: DataFrame, strict: bool = False) -> DataFrame:
    """The spans (doc_id, value, type, ...) for which no annotation of their document with a fitting type equals, contains or is contained in their value.

    Values are compared once for each document and distinct value.
    """
    d = spans.select(F.col("doc_id").alias("d_doc"), F.col("value").alias("d_value"), F.col("type").alias("d_type")).distinct()
    known = notes.where("value <> ''").select("doc_id", "value", "type").distinct()
    near = F.col("value").contains(F.col("d_value")) | F.col("d_value").contains(F.col("value"))
    good = d.join(known, (F.col("doc_id") == F.col("d_doc")) & _fits(F.col("type"), F.col("d_type"), strict) & near, "left_semi")
    return spans.join(good, F.col("doc_id").eqNullSafe(F.col("d_doc")) & F.col("value").eqNullSafe(F.col("d_value")) & F.col("type").eqNullSafe(F.col("d_type")), "left_anti")


def score(notes: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """notes (doc_id, text, value, type), spans (doc_id, start, end, value, type) -> one row of totals and rates.

    A span hits an occurrence that it covers, if the types are equal or (unless strict) the span's is
    `detail`. A span is false if no annotation of its document with a fitting type equals, contains or is
    contained in its value.
    """
    o = covered(occurrences(notes), spans.withColumn("rule", F.lit("")), strict)
    wrong = unfounded(spans, notes, strict)
    found = o.agg(F.count("*").alias("occurrences"), F.count("rule").alias("hits"))
    totals = [spans.agg(F.count("*").alias("detections")), wrong.agg(F.count("*").alias("false_positives"))]
    out = found
    for t in totals:
        out = out.crossJoin(t)  # one row each
    return out.withColumn("recall", F.col("hits") / F.col("occurrences")).withColumn("false_rate", F.col("false_positives") / F.col("detections"))


def metrics(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """notes (doc_id, text, value, type, lang), spans (doc_id, start, end, value, type, rule, lang) -> matching, by, type, rule, lang and the counts and rates of `score`.

    matching is `strict` or `lenient`. by names what a row is for: `all`, `type`, `lang`, `type and lang` or `rule`. An occurrence counts under
    its annotation's type, and under the rule that hit it (none: null); a detection under its own. Rates without a denominator are null.
    """
    places, facts = occurrences(notes), None
    one, none = F.lit(1), F.lit(0)
    for matching, strict in (("strict", True), ("lenient", False)):
        o = covered(places, spans, strict).select(F.lit(matching).alias("matching"), "type", "rule", "lang", one.alias("o"), F.col("rule").isNotNull().cast("int").alias("h"), none.alias("d"), none.alias("f"))
        d = spans.select(F.lit(matching).alias("matching"), "type", "rule", "lang", none.alias("o"), none.alias("h"), one.alias("d"), none.alias("f"))
        w = unfounded(spans, notes, strict).select(F.lit(matching).alias("matching"), "type", "rule", "lang", none.alias("o"), none.alias("h"), none.alias("d"), one.alias("f"))
        facts = o.union(d).union(w) if facts is None else facts.union(o).union(d).union(w)
    m, t, r, l = (F.col(c) for c in ("matching", "type", "rule", "lang"))
    names = {7: "all", 3: "type", 6: "lang", 2: "type and lang", 5: "rule"}  # grouping_id: a bit for each of type, rule and lang that is left out
    sums = facts.groupingSets([[m], [m, t], [m, l], [m, t, l], [m, r]], m, t, r, l).agg(F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in "ohdf"))
    by = F.lit(None).cast("string")
    for g, name in names.items():
        by = F.when(F.col("g") == g, name).otherwise(by)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.select("matching", by.alias("by"), "type", "rule", "lang", F.col("o").alias("occurrences"), F.col("h").alias("hits"), F.col("d").alias("detections"), F.col("f").alias("false_positives"), rate("h", "o").alias("recall"), rate("f", "d").alias("false_rate"))
