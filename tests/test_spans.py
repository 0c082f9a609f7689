import random

from pyspark.sql import functions as F

from veilwork.operators.replace import REMOVED, code_table, redact, reserved_tokens, restore, restore_flags
from veilwork.operators.spans import apply_manual, merge_confirmed, merge_ranges, resolve_overlaps

KIND = "doc_id long, text string, spans array<struct<start:int,end:int,type:string,layer:string,confidence:double,priority:int,rule_seq:int>>"


def drawn(seed, n=200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        spans = []
        for _ in range(r.randrange(9)):
            a = r.randrange(-1, 30)
            spans.append((a, a + r.randrange(-1, 9), r.choice(["name", "email", "odd"]), "regex", r.randrange(9) / 10, r.choice([60, 80, 120]), r.randrange(4)))
        rows.append((i, "abcdefghijklmnopqrstuvwxyz012345"[: r.choice([20, 32])], spans))
    return rows


def sequential(text, spans, mode):
    ok = [s for s in spans if s[0] >= 0 and s[1] > s[0] and (mode == "resolve" or s[1] <= len(text))]
    ok.sort(key=lambda s: (s[0], -s[1], -s[5], s[6]) if mode == "resolve" else (s[0], -s[1]))
    out = []
    for a, b, kind, _, conf, *_ in ok:
        kind = kind if mode == "resolve" or kind != "odd" else "detail"
        if not out or a >= out[-1][1]:
            out.append([a, b, kind, conf])
        elif mode != "resolve" or b > out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] = out[-1][2] if out[-1][2] == kind else "detail"
            out[-1][3] = max(out[-1][3], conf)
    return out


def test_merges_equal_a_sequential_walk(spark):
    made = drawn(4)
    df = spark.createDataFrame(made, KIND)
    text, spans = F.col("text"), F.col("spans")
    got = df.select("doc_id", resolve_overlaps(text, spans).alias("a"), merge_confirmed(text, spans).alias("b"), merge_ranges(text, spans).alias("c"), redact(text, spans).alias("r")).collect()
    for g in got:
        _, body, own = made[g.doc_id]
        assert [(s.start, s.end) for s in g.a] == [tuple(s[:2]) for s in sequential(body, own, "resolve")]
        assert [(s.start, s.end, s.type) for s in g.b] == [tuple(s[:3]) for s in sequential(body, own, "merge")]
        ranges = [tuple(s[:2]) for s in sequential(body, own, "merge")]
        assert [(s.start, s.end) for s in g.c] == ranges
        want, at = "", 0
        for a, b in ranges:
            want, at = want + body[at:a] + REMOVED, b
        assert g.r == want + body[at:]


def test_manual_terms_grow_over_what_they_cross(spark):
    df = spark.createDataFrame([(1, "0123456789", [(1, 3, "name", "list", 0.9, 0, 0), (4, 6, "email", "regex", 0.8, 0, 0), (8, 9, "date", "regex", 0.7, 0, 0)])], KIND)
    places = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")))
    got = df.select(apply_manual(F.col("text"), F.col("spans"), places, "phone").alias("s")).first().s
    assert [(s.start, s.end, s.value, s.type, s.layer, s.confidence) for s in got] == [(1, 6, "12345", "phone", "manual", 1.0), (8, 9, "8", "date", "regex", 0.7)]


def test_reserved_numbers_and_flags(spark):
    text = "[[email_001]] [[EMAIL_0002]] [[EMAIL_003]] a@b.de c@d.de a@b.de e@f.de"
    spans = [(text.index(x, k), text.index(x, k) + 6, "email", "regex", 0.9, 0, 0) for x, k in (("a@b.de", 0), ("c@d.de", 0), ("a@b.de", text.index("c@d")), ("e@f.de", 0))]
    df = spark.createDataFrame([(1, text, spans)], KIND).withColumn("codes", code_table(F.col("text"), F.col("spans")))
    r = df.select("codes", reserved_tokens(F.col("text")).alias("reserved")).first()
    assert [(c.original, c.pseudonym) for c in r.codes] == [("a@b.de", "[[EMAIL_002]]"), ("c@d.de", "[[EMAIL_004]]"), ("e@f.de", "[[EMAIL_005]]")]
    reply = F.lit("[[email_002]]'s and [[[EMAIL_004]] [[EMAIL_005]]] EMAIL_4 [IP_1]] [[email_001]] [[BSN_012]] [[BSN_1]] xEMAIL_7")
    got = df.select(restore(reply, F.col("codes")).alias("t"), restore_flags(reply, F.col("codes"), reserved_tokens(F.col("text"))).alias("f")).first()
    assert got.t.startswith("a@b.de's and [[[EMAIL_004]] [[EMAIL_005]]] EMAIL_4")
    flags = [(f.pseudonym, f.reason.split(" ")[1]) for f in got.f]
    assert flags[:2] == [("[[EMAIL_004]]", "missing"), ("[[EMAIL_005]]", "missing")]
    assert {p for p, r in flags if r == "placeholder;"} == {"[[[EMAIL_004]]", "[[EMAIL_005]]]", "EMAIL_4", "[IP_1]]", "[[BSN_012]]", "[[BSN_1]]"}
