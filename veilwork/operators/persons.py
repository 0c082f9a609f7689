"""Names from a table of token predictions (the layer `ner`).

A model's tokens carry B-/I- tags and word pieces (`##` continues a word). Runs of person tokens are found by windows
over a document's tokens, and a grouping joins their pieces; the runs are then located in the text by an automaton.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import SINGLE_PRIORITY
from .detect import long_spans
from .islands import resolved
from .terms import places

#: Least score of a run, and what a span of the layer counts as among candidates that start and end alike.
LEAST_SCORE, PRIORITY, RULE_SEQ = 0.6, SINGLE_PRIORITY, 40
FOUND = "array<struct<start:int,end:int,value:string,type:string,layer:string,confidence:double>>"
_PARTS = regex.compile(r"[\s﻿-]+")


def person_runs(tokens: DataFrame, key: str = "doc_id", order: str = "seq", least: float = LEAST_SCORE) -> DataFrame:
    """tokens (key, order, word, tag, score) -> key, run, word, score: the names that the tags spell, in order.

    A person token begins a run if none stands before it, or if it is tagged B- and is no continuation. A null or zero
    score counts as 1; a run's score is its least; runs below `least` or of one letter are left out.
    """
    word, before = F.coalesce("word", F.lit("")), Window.partitionBy(key).orderBy(order)
    rows = tokens.select(key, order, word.alias("word"), F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("score")).alias("score"), F.coalesce("tag", F.lit("")).alias("tag"))
    rows = rows.withColumn("person", F.col("tag").rlike("(?i)PER")).withColumn("goes_on", F.col("word").startswith("##"))
    open_ = F.coalesce(F.lag("person").over(before), F.lit(False))
    begins = F.col("person") & ~(open_ & (F.col("goes_on") | ~F.col("tag").rlike("(?i)^B-")))
    rows = rows.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(before)).where("person")
    piece = F.concat(F.when(F.col("begins") | F.col("goes_on"), "").otherwise(" "), F.when(F.col("goes_on"), F.substring("word", 3, 1 << 30)).otherwise(F.col("word")))
    runs = rows.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))).alias("x"), F.min("score").alias("score"))
    runs = runs.select(key, "run", F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("word"), "score")
    return runs.where((F.col("score") >= least) & (F.length("word") >= 2))


def locate(text: str, runs: list[tuple[str, float]]) -> list[dict]:
    """The spans of the runs in a text, in the order in which they are looked for.

    Each name is looked for once, in whatever case it comes first; a name that the text does not hold as it is, or that was
    looked for before, is looked for by its parts of three letters or more.
    """
    names = [(word.strip(), score) for word, score in runs]
    parts = {name: [p for p in _PARTS.split(name) if len(p) >= 3] for name, _ in names}
    spellings = tuple(dict.fromkeys(x for name, own in parts.items() for x in (name, *own) if len(x) >= 2))
    done: set[str] = set()
    at: dict[str, list[int]] = {}
    for start, _, n in places(text, spellings):
        at.setdefault(spellings[n], []).append(start)
    out: list[dict] = []

    def add(part: str, score: float) -> bool:
        if len(part) < 2 or part.lower() in done:
            return False
        done.add(part.lower())
        sure = int((score or 0.5) * 100 + 0.5) / 100
        out.extend({"start": s, "end": s + len(part), "value": part, "type": "name", "layer": "ner", "confidence": sure} for s in at.get(part, ()))
        return part in at

    for name, score in names:
        if not add(name, score):
            for part in parts[name]:
                add(part, score)
    return out


def located(text: Column, runs: Column) -> Column:
    """`locate` for a text and its runs, an array of (word, score)."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([locate(t or "", [(r["word"], r["score"]) for r in own] if own is not None else []) for t, own in zip(texts, lists, strict=True)], dtype=object)

    return found(text, runs)


def person_spans(docs: DataFrame, tokens: DataFrame, key: str = "doc_id", text: str = "text", order: str = "seq") -> DataFrame:
    """docs (key, text), tokens -> key, start, end, value, type, layer, confidence. Documents without tokens have no rows; tokens without a document are left out."""
    runs = person_runs(tokens, key, order).groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("run", "word", "score"))).alias("__runs"))
    met = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).join(runs, F.col(key) == F.col("__key"))
    return long_spans(met, key, spans=located(F.col("__text"), F.transform("__runs", lambda r: F.struct(r["word"], r["score"]))))


def with_persons(spans: DataFrame, persons: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of other layers (key, start, end, type, layer, confidence, priority, rule_seq) and of this one, resolved together."""
    own = persons.select(key, "start", "end", "type", "layer", "confidence", F.lit(PRIORITY).alias("priority"), F.lit(RULE_SEQ).alias("rule_seq"))
    return resolved(spans.select(own.columns).union(own), key)
