import time
from collections import Counter

from pyspark.sql import functions as F

from veilwork.operators.sessions import anonymize_sessions, session_codes
from veilwork.streaming.mapper import STORE, map_sessions

SPANS = "array<struct<start:int,end:int,type:string>>"


def brute_codes(docs):
    """Counting as a mapper does, with all tokens of a session reserved."""
    import re

    held, out, seen, last = {}, {}, Counter(), Counter()
    for s, _, text, _ in docs:
        held.setdefault(s, set()).update(t.lower() for t in re.findall(r"(?i)\[\[[A-Z][A-Z0-9_]*_\d{3,}\]\]", text))
    for s, _, text, spans in sorted(docs, key=lambda d: d[1]):
        for a, b, kind in spans:
            if (s, kind, text[a:b]) not in out:
                last[s, kind] += 1
                while f"[[{kind.upper()}_{last[s, kind]:03d}]]".lower() in held[s]:
                    last[s, kind] += 1
                seen[s] += 1
                out[s, kind, text[a:b]] = (f"[[{kind.upper()}_{last[s, kind]:03d}]]", seen[s])
    return out


def made(n):
    docs = []
    for k in range(n):
        words = [f"v{(k * 7 + j * j) % 23}" for j in range(6)]
        text, spans = f"[[email_{k % 9 + 3:03d}]] [[Date_{k}]] [[EMAIL_0{k % 5 + 10:03d}]] ", []
        for j, w in enumerate(words):
            spans.append((len(text), len(text) + len(w), "email" if j % 3 else "date"))
            text += w + " "
        docs.append((f"s{k % 2}", k, text, spans))
    return docs


def test_codes_skip_reserved_numbers_as_by_counting(spark):
    docs = made(40)
    df = spark.createDataFrame(docs, f"source string, doc_id long, text string, spans {SPANS}")
    got = {(r.session, r.type, r.original): (r.pseudonym, r.ord) for r in session_codes(df.repartition(5), "source", "doc_id").collect()}
    assert got == brute_codes(docs)


def test_a_session_of_a_hundred_thousand_values(spark):
    text = F.concat(F.lit("v"), F.col("id").cast("string"))
    span = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("email").alias("type")))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.when(F.col("id") % 1000 == 0, F.concat(text, F.lit(" [[email_050]]"))).otherwise(text).alias("text"), span.alias("spans"))
    began = time.time()
    codes = session_codes(docs, "source", "doc_id")
    rows = {r.original: (r.pseudonym, r.ord) for r in codes.collect()}
    assert time.time() - began < 60
    assert len(rows) == 100_000 and rows["v48"] == ("[[EMAIL_049]]", 49) and rows["v49"] == ("[[EMAIL_051]]", 50) and rows["v99999"] == ("[[EMAIL_100001]]", 100_000)


def test_spans_of_null_sessions_and_texts(spark):
    df = spark.createDataFrame([(1, None, "a@b.de x", [(0, 6, "email")]), (2, None, None, []), (3, "t", "", None)], f"doc_id long, source string, text string, spans {SPANS}")
    got = {r.doc_id: r.anonymized for r in anonymize_sessions(df, session_codes(df, "source", "doc_id"), "source").collect()}
    assert got == {1: "[[EMAIL_001]] x", 2: "", 3: ""}


def test_codes_go_on_over_batches_and_a_restart(spark, tmp_path):
    docs = [d for d in made(30)]
    held = [(s, k, text if k < 15 else text.replace("[[", "<<"), spans) for s, k, text, spans in docs]  # the first batch reserves
    df = spark.createDataFrame(held, f"source string, doc_id long, text string, spans {SPANS}")
    codes = session_codes(df, "source", "doc_id")
    want = {r.doc_id: r.anonymized for r in anonymize_sessions(df, codes, "source").collect()}
    spark.conf.set(*STORE)
    for part in ("doc_id < 15", "doc_id >= 15"):  # each a run of its own: the second starts from the first one's checkpoint
        df.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        query = map_sessions(stream, "source", "doc_id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.doc_id: r.anonymized for r in out} == want and len(out) == 30
    given = {(r.source, c.type, c.original): c.pseudonym for r in out for c in r.codes}
    assert given == {(r.session, r.type, r.original): r.pseudonym for r in codes.collect()}
