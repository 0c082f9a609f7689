"""Texts with very many places: values, unions and parts as by plain Python, in time that does not grow with their square."""

import random
import time

from pyspark.sql import functions as F

from veilwork.functions.textops import with_cuts
from veilwork.operators.replace import REMOVED, redact
from veilwork.operators.spans import merge_confirmed, resolve_overlaps
from veilwork.plans.rules import regex_candidates


def test_cuts_equal_slices(spark):
    pick = random.Random(5)
    texts = ["", "a", "é😀", *("".join(pick.choices("ab é😀\n﷐", k=n)) for n in (7, 64, 65, 1000))]
    rows = [(t, [(a, pick.randrange(0, len(t) - a + 1)) for a in (pick.randrange(0, len(t) + 1) for _ in range(k))]) for t in texts for k in (0, 1, 3, 50)]
    df = spark.createDataFrame(rows, "t string, at array<struct<a:int,n:int>>")
    got = df.select("t", "at", with_cuts(F.col("t"), F.size("at"), lambda cut: F.transform("at", lambda x: cut(x["a"], x["n"]))).alias("cuts")).collect()
    assert all(r.cuts == [r.t[x.a : x.a + x.n] for x in r["at"]] for r in got) and len(got) == len(rows)


def test_dense_text(spark):
    n = 12_000
    mails = [f"mail{k}@example.org" for k in range(n)]
    text = " ﷐ ".join(f"é😀 {m}" for m in mails)
    spark.createDataFrame([("a b@c.de",)], "text string").select(regex_candidates(F.col("text"), ["email"])).collect()
    df = spark.createDataFrame([(text,)], "text string").withColumn("c", regex_candidates(F.col("text"), ["email"])).checkpoint()
    began = time.time()
    row = df.withColumn("s", resolve_overlaps(F.col("text"), F.col("c"))).select("c", "s", merge_confirmed(F.col("text"), F.col("s")).alias("m"), redact(F.col("text"), F.col("s")).alias("r")).first()
    assert time.time() - began < 60  # copying the list at each span took minutes
    assert [x.value for x in row.c] == mails == [x.value for x in row.s] == [text[x.start : x.end] for x in row.m]
    assert row.r == " ﷐ ".join(f"é😀 {REMOVED}" for _ in mails)
