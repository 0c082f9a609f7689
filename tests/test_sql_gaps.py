"""Texts on which the queries' simpler SQL differs from the reference's rules: what the rules give is kept."""

from pyspark.sql import functions as F

from veilwork.operators.detect import detect
from veilwork.operators.spans import resolve_overlaps
from veilwork.plans.rules import regex_candidates

CASES = [
    ("ask +1 (569) 555-6633 4792 now", [("phone", "+1 (569) 555-6633")]),  # a number is not cut inside a run of digits
    ("ref 088395838205801 here", [("phone", "088395838205801")]),  # a form without `+`
    ("+1 (843) 555-7672 170.106.47.218", [("detail", "+1 (843) 555-7672 170.106.47.218")]),  # crossing spans become their union
    ("at 65.95.187.82 thtihe st, so", [("detail", "65.95.187.82 thtihe st")]),  # an address crosses a number
]


def test_reference_forms(spark):
    df = spark.createDataFrame(CASES, "text string, want array<struct<type:string,value:string>>")
    phones = resolve_overlaps(F.col("text"), regex_candidates(F.col("text"), ["phone_intl", "phone_nanp"]))
    rows = detect(df.coalesce(1)).withColumn("phones", phones).collect()
    assert [[(s.type, s.value) for s in r.spans] for r in rows] == [want for _, want in CASES]
    assert [[s.value for s in r.phones] for r in rows[:2]] == [[v for _, v in want] for _, want in CASES[:2]]
