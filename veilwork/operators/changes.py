"""Detection of texts that are new or changed only.

A memo holds the spans of every text seen, by a digest of the text. The next run detects the distinct texts that the
memo lacks, whoever holds them, and all others take their spans from it. Decisions of a review name the digest of the
text that they were made on, so a text that changes loses them, and gets them back if it changes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .detect import detect


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(docs: DataFrame, memo: DataFrame | None, text: str = "text") -> DataFrame:
    """digest, text: the distinct texts of docs that the memo (digest, spans) lacks. Only digests meet the memo before texts are gathered."""
    rows = docs.select(text_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if memo is not None:
        rows = rows.join(memo.select("digest"), "digest", "left_anti")
    return rows.groupBy("digest").agg(F.min("text").alias("text"))


def refreshed(docs: DataFrame, memo: DataFrame | None = None, text: str = "text", find: Callable[[DataFrame], DataFrame] = detect) -> tuple[DataFrame, DataFrame]:
    """(the memo with what docs needs, the part of it that this run computed), both written tables of digest and spans.

    find: adds `spans` to a table with a column text. Texts that no document holds any more stay in the memo.
    """
    new = stored(find(unseen(docs, memo, text)).select("digest", "spans"), "spans")
    return (new if memo is None else stored(memo.select("digest", "spans").unionByName(new), "memo")), new


def remembered(docs: DataFrame, memo: DataFrame, text: str = "text") -> DataFrame:
    """docs with `digest` and the memo's `spans`. The memo has one row a text, so a text held by many documents is one hot key of the join, which Spark splits."""
    return docs.withColumn("digest", text_digest(F.col(text))).join(memo.select(F.col("digest").alias("__of"), "spans"), F.col("digest") == F.col("__of"), "left").drop("__of")


def standing(decisions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The decisions (key, digest, ...) that were made on the text that their document has now."""
    now = docs.select(F.col(key).alias("__key"), text_digest(F.col(text)).alias("__now")).distinct()
    return decisions.join(now, F.col(key).eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__now")), "left_semi")
