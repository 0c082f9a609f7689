"""Review of detected spans: outside decisions, manual terms, and the text that is handed on.

Detected spans are confirmed unless a decision says otherwise. Decisions and manual terms are tables of
their own, keyed by document, so a review can be done anywhere and joined later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import islands
from .spans import known_type
from .terms import term_places

#: Wording of the handed-on text.
REQUEST, TEXT = "REQUEST", "TEXT"
RULES = {
    "codes": "The text below holds codes such as [[PERSON_001]] instead of personal details. Keep every code exactly as it is, and do not guess what it stands for.",
    "remove": "Personal details were taken out of the text below and [REMOVED] stands in their place. Do not guess what was removed.",
}


def decide(spans: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, start, end, ...), decisions (key, start, end, confirmed) -> spans with a column confirmed.

    A span without a decision, or with a null one, is confirmed; of several decisions on a span one rejection rejects
    it; decisions on spans that do not exist are ignored.
    """
    said = decisions.groupBy(F.col(key).alias("__key"), F.col("start").alias("__start"), F.col("end").alias("__end")).agg(F.min("confirmed").alias("confirmed"))
    same = (F.col(key) == F.col("__key")) & (F.col("start") == F.col("__start")) & (F.col("end") == F.col("__end"))
    return spans.join(said, same, "left").select(*spans.columns, F.coalesce("confirmed", F.lit(True)).alias("confirmed"))


def reviewed(docs: DataFrame, spans: DataFrame, decisions: DataFrame, terms: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """docs (key, text, ...) with a column `confirmed`: the spans that outlast the review, an array for `redact` or `anonymize`.

    terms (key, term, type): every place of a term in its document, in any case, is one more span; places of one term do
    not overlap. It takes in the detected spans that it overlaps, rejected ones too, as often as it grows, and its type wins
    (of several terms the last one's, in code-point order). Blank terms are none; a null type is `detail`.
    """
    rows = decide(spans, decisions, key).select(F.col(key).alias("__key"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "confirmed", F.lit(-1).alias("n"))
    if terms is not None:
        said = terms.where(F.trim("term") != "").select(F.col(key).alias("__key"), F.struct(F.trim("term").alias("term"), known_type(F.col("type")).alias("type")).alias("t"))
        own = said.groupBy("__key").agg(F.array_sort(F.collect_set("t")).alias("__terms"))
        met = docs.select(F.col(key).alias("__of"), F.coalesce(F.col("text"), F.lit("")).alias("__text")).join(own, F.col("__of") == F.col("__key"))
        found = F.explode_outer(term_places(F.col("__text"), F.transform("__terms", lambda t: t["term"])))
        manual = met.select("__key", "__terms", found.alias("p")).where("p is not null")
        rows = rows.unionByName(manual.select("__key", "p.start", "p.end", F.get("__terms", F.col("p.n"))["type"].alias("type"), F.lit(True).alias("confirmed"), F.col("p.n").alias("n")))
    # Unions of overlapping spans; one that holds a manual span is confirmed and of its type, others keep their confirmed members.
    rows = islands(rows, "__key")
    whole = Window.partitionBy("__key", "island")
    by_hand = F.max("n").over(whole) >= 0
    last = F.max(F.struct("n", "type")).over(whole)["type"]
    edges = F.min("start").over(whole), F.max("end").over(whole)
    rows = rows.select("__key", F.when(by_hand, edges[0]).otherwise(F.col("start")).alias("start"), F.when(by_hand, edges[1]).otherwise(F.col("end")).alias("end"), F.when(by_hand, last).otherwise(F.col("type")).alias("type"), (by_hand | F.col("confirmed")).alias("confirmed"))
    kept = rows.where("confirmed").groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "type"))).alias("confirmed"))
    both = docs.join(kept, F.col(key) == F.col("__key"), "left").drop("__key")
    return both.withColumn("confirmed", F.coalesce("confirmed", F.array().cast("array<struct<start:int,end:int,type:string>>")))


def request_text(task: Column, text: Column) -> Column:
    """The text that is detected and reviewed: a request and the source, each below its heading."""
    return F.concat(F.lit(REQUEST + "\n"), F.trim(F.coalesce(task, F.lit(""))), F.lit(f"\n\n{TEXT}\n"), F.coalesce(text, F.lit("")))


def prompt(safe_text: Column, mode: str = "codes") -> Column:
    """What is handed on: the rules of the mode (`codes` or `remove`), then the text without personal details."""
    return F.concat_ws("\n\n", F.lit(RULES[mode]), safe_text)
