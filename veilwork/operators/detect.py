"""Detection: candidates of all rules, lists and columns of a text, and the spans they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import SPANS, regex_candidates
from .columns import column_candidates
from .names import NameLists, name_candidates
from .spans import resolve_overlaps


def candidates(text: Column, lists: NameLists | None = None, columns: bool = True) -> Column:
    """All candidate spans. Regular expressions run in the JVM; delimited columns and name lists in Arrow batches."""
    parts = [regex_candidates(text)]
    if columns:
        parts.append(column_candidates(text).cast(SPANS))
    if lists:
        parts.append(name_candidates(text, lists).cast(SPANS))
    return F.concat(*parts)


def detect(docs: DataFrame, text: str = "text", lists: NameLists | None = None, columns: bool = True, into: str = "spans") -> DataFrame:
    """Adds array<struct<start, end, value, type, layer, confidence>>: sorted, disjoint spans of personal details.

    A null text has none. Rows stay in place: nothing is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__candidates", candidates(body, lists, columns)).withColumn(into, resolve_overlaps(body, F.col("__candidates"))).drop("__candidates")


def long_spans(docs: DataFrame, *keys: str, spans: str | Column = "spans") -> DataFrame:
    """One row per span.

    A plain `explode` would make Spark infer a filter on the spans' number and compute all of them once more in it.
    """
    return docs.select(*keys, F.explode_outer(spans).alias("s")).where("s is not null").select(*keys, "s.*")
