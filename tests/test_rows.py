"""Operators on tables of spans, terms and tokens, each against a plain version."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilwork.operators import changes
from veilwork.operators.evaluate import covered, metrics, occurrences, score, unfounded
from veilwork.operators.islands import confirmed, ranges, redacted, resolved
from veilwork.operators.persons import locate, person_runs, person_spans, with_persons
from veilwork.operators.replace import redact
from veilwork.operators.review import reviewed
from veilwork.operators.spans import merge_confirmed, merge_ranges, resolve_overlaps
from veilwork.operators.terms import fold_each, places, term_places

SPAN = "doc_id long, start int, end int, type string, layer string, confidence double, priority int, rule_seq int"


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(4)
    rows = [(r.randrange(30) if r.random() < 0.5 else 7, a, a + r.randint(-1, 9), r.choice(["name", "email", "detail", "odd"]), r.choice("ab"), r.random(), r.choice([60, 80]), r.randrange(9)) for a in (r.randrange(-1, 900) for _ in range(3000))]
    return spark.createDataFrame([*rows, (None, 1, 4, "name", "a", 0.5, 60, 1), (1, None, 3, "name", "a", 0.5, 60, 1)], SPAN)


def folded(spans, fold):
    rows = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*spans.columns[1:])).alias("x")).withColumn("text", F.repeat(F.lit("abcdefghij"), F.lit(100)))
    return rows.select("doc_id", F.explode(fold(F.col("text"), F.col("x"))).alias("s"))


def test_islands_equal_folds(spans):
    got = Counter(tuple(r) for r in ranges(spans).collect())
    assert got == Counter(tuple(r) for r in folded(spans, merge_ranges).select("doc_id", "s.*").collect())
    got = Counter(tuple(r) for r in confirmed(spans).collect())
    assert got == Counter(tuple(r) for r in folded(spans, merge_confirmed).select("doc_id", "s.*").collect())
    want = folded(spans.where("start is not null"), resolve_overlaps).select("doc_id", "s.start", "s.end", "s.type", "s.layer", "s.confidence")
    assert Counter(tuple(r) for r in resolved(spans).collect()) == Counter(tuple(r) for r in want.collect())


def test_a_text_with_a_hundred_thousand_spans(spark):
    docs = spark.createDataFrame([(1, "ab " * 100_000), (2, None), (3, "none")], "doc_id long, text string")
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 2).cast("int").alias("end"))
    began = time.time()
    got = {r.doc_id: r.redacted for r in redacted(docs, many.union(many)).collect()}
    assert time.time() - began < 60 and got == {1: "[REMOVED] " * 100_000, 2: "", 3: "none"}
    few = spark.createDataFrame([(3, 1, 3), (3, 2, 4), (3, 3, 9)], "doc_id long, start int, end int")
    want = docs.where("doc_id = 3").select(redact(F.col("text"), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 3), (2, 4), (3, 9)))))).first()[0]
    assert redacted(docs, few).where("doc_id = 3").first().redacted == want == "n[REMOVED]"


def test_folding_keeps_places():
    text = "İİİ Bo ẞ ß K ſ ᾈ ŉ ẞ"
    assert len(fold_each(text)) == len(text) and fold_each("ẞSſK") == "ßssk" and fold_each("İ") == "İ"


def brute_places(text, terms):
    for n, term in enumerate(terms):
        at = text.find(term) if term else -1
        while at >= 0:
            yield at, at + len(term), n
            at = text.find(term, at + len(term))


def test_places_equal_searches(spark):
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choices("aabİß ", k=r.randrange(80)))
        terms = tuple("".join(r.choices("abİß", k=r.randrange(4))) for _ in range(r.randrange(9)))
        assert sorted(places(text, terms)) == sorted(brute_places(text, terms))
    df = spark.createDataFrame([("İİ bo Bo BOBO", ["bo", "x", None, "İ"]), (None, ["a"]), ("a", None), ("", [])], "t string, l array<string>")
    got = [[(p.start, p.end, p.n) for p in row[0]] for row in df.select(term_places(F.col("t"), F.col("l"))).collect()]
    assert sorted(got[0]) == [(0, 1, 3), (1, 2, 3), (3, 5, 0), (6, 8, 0), (9, 11, 0), (11, 13, 0)] and got[1:] == [[], [], []]


def test_reviewed_texts_leak_nothing(spark):
    docs = spark.createDataFrame([(1, "İİİ ask Bo Smit now, BO SMIT"), (2, "aXaXa Straße STRASSE"), (3, None), (4, "ab cd ef"), (5, "free")], "doc_id long, text string")
    found = spark.createDataFrame([(4, 0, 5, "email"), (4, 4, 8, "url"), (5, 0, 4, "date")], "doc_id long, start int, end int, type string")
    said = spark.createDataFrame([(5, 0, 4, False), (4, 4, 8, False), (5, 0, 4, None)], "doc_id long, start int, end int, confirmed boolean")
    terms = spark.createDataFrame([(1, " bo smit ", "name"), (2, "axa", "detail"), (2, "straSSe", None), (2, " ", "name"), (4, "B C", "phone"), (9, "x", "name"), (3, "x", "name")], "doc_id long, term string, type string")
    rows = {r.doc_id: r for r in reviewed(docs, found, said, terms).withColumn("safe", redact(F.col("text"), F.col("confirmed"))).collect()}
    assert {i: r.safe for i, r in rows.items()} == {1: "İİİ ask [REMOVED] now, [REMOVED]", 2: "[REMOVED]Xa Straße [REMOVED]", 3: "", 4: "[REMOVED]", 5: "free"}
    assert [(s.start, s.end, s.type) for s in rows[4].confirmed] == [(0, 8, "phone")]
    plain = {r.doc_id: [(s.start, s.end) for s in r.confirmed] for r in reviewed(docs, found, said).collect()}
    assert plain == {1: [], 2: [], 3: [], 4: [(0, 5)], 5: []}


def test_terms_in_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "ab" * 500_000)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "ab" * k + "c" * (k % 2), "name") for k in range(1, 200)], "doc_id long, term string, type string")
    none = spark.createDataFrame([], "doc_id long, start int, end int, type string")
    began = time.time()
    row = reviewed(docs, none, none.select("doc_id", "start", "end", F.lit(True).alias("confirmed")), terms.where("term not like '%c'")).first()
    assert time.time() - began < 60 and len(row.confirmed) >= 1


TOKENS = "doc_id long, seq long, word string, tag string, score double"


def brute_runs(tokens):
    groups, now = [], None
    for word, tag, s in tokens:
        person, goes_on = "PER" in tag.upper(), word.startswith("##")
        if person and now and (goes_on or not tag.upper().startswith("B-")):
            now = [now[0] + (word[2:] if goes_on else " " + word), min(now[1], s or 1)]
            groups[-1] = now
        elif person:
            now = [word[2:] if goes_on else word, s or 1]
            groups.append(now)
        else:
            now = None
    return [(w, s) for w, s in groups if s >= 0.6 and len(w) >= 2]


def test_runs_of_person_tokens(spark):
    r = random.Random(8)
    docs = {k: [(r.choice(["An", "##na", "Bo", "##b", "o", "-"]), r.choice(["B-PER", "I-PER", "I-per", "O", "B-LOC", "", "PER"]), r.choice([0.9, 0.7, 0.5, 0.0, 1.0])) for _ in range(60)] for k in range(12)}
    rows = [(k, n, w, t or None, s or None) for k, tokens in docs.items() for n, (w, t, s) in enumerate(tokens)]
    got = {}
    for x in person_runs(spark.createDataFrame(rows, TOKENS).repartition(4)).orderBy("doc_id", "run").collect():
        got.setdefault(x.doc_id, []).append((x.word, x.score))
    assert got == {k: brute_runs(tokens) for k, tokens in docs.items()}


def test_names_are_located_and_merged(spark):
    text = "Anna Okonkwo-Vermeulen met ANNA and Bo. Anna, Bo!"
    found = locate(text, [("Okonkwo - Vermeulen", 0.876), ("Bo", 0.7), ("anna", 0.9), ("Anna", 0.8), ("Bo", 0.61), ("Zed", 0.9)])
    assert [(s["value"], s["start"], s["confidence"]) for s in found] == [("Okonkwo", 5, 0.88), ("Vermeulen", 13, 0.88), ("Bo", 36, 0.7), ("Bo", 46, 0.7)]
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    tokens = spark.createDataFrame([(1, 0, "Anna", "B-PER", 0.9), (1, 1, "Okx", "I-PER", 0.9), (1, 2, "met", "O", 0.9), (1, 3, "Bo", "B-PER", 0.8), (9, 0, "Bo", "B-PER", 0.8), (3, 0, "Bo", "B-PER", 0.8)], TOKENS)
    spans = person_spans(docs, tokens)
    assert sorted((r.doc_id, r.start, r.value) for r in spans.collect()) == [(1, 0, "Anna"), (1, 36, "Bo"), (1, 40, "Anna"), (1, 46, "Bo")]
    other = spark.createDataFrame([(1, 0, 22, "name", "custom", 0.99, 80, 35), (1, 30, 38, "email", "regex", 0.9, 120, 8)], SPAN)
    assert sorted((r.start, r.end, r.type, r.layer) for r in with_persons(other, spans).collect()) == [(0, 22, "name", "custom"), (30, 38, "email", "regex"), (40, 44, "name", "ner"), (46, 48, "name", "ner")]


def test_metrics_equal_plain_counting(spark):
    r = random.Random(3)
    texts = {k: "".join(r.choices("ab \\E.", k=400 + 300 * (k % 3))) for k in range(14)}
    lang = lambda k: ["en", "nl", None][k % 3]
    notes = [(k, t, t[a : a + r.randint(1, 4)] if r.random() < 0.9 else "zz", r.choice(["name", "email"]), lang(k)) for k, t in texts.items() for a in (r.randrange(300) for _ in range(6))]
    spans = [(k, a, a + w, t[a : a + w], r.choice(["name", "email", "detail"]), r.choice(["r1", "r2"]), lang(k)) for k, t in texts.items() for a, w in ((r.randrange(390), r.choice([1, 3, 9, 300])) for _ in range(40))]
    n = spark.createDataFrame(notes, "doc_id long, text string, value string, type string, lang string")
    s = spark.createDataFrame(spans, "doc_id long, start int, end int, value string, type string, rule string, lang string")
    places = []
    for k, value, kind in {(k, v, t) for k, _, v, t, _ in notes if v}:
        at = [i for i in range(len(texts[k])) if texts[k].startswith(value, i)]
        places += [(k, value, kind, i) for i in at or [None]]
    assert Counter((x.doc_id, x.value, x.type, x.start) for x in occurrences(n).collect()) == Counter(places)
    got = {(x.matching, x.by, x.type, x.rule, x.lang): tuple(x)[5:] for x in metrics(n, s).collect()}
    for strict in (True, False):
        fits = lambda a, b: a == b or (not strict and b == "detail")  # noqa: E731,B023
        hit = {p: min((x[5] for x in spans if p[3] is not None and x[0] == p[0] and fits(p[2], x[4]) and x[1] <= p[3] and x[2] >= p[3] + len(p[1])), default=None) for p in places}
        wrong = [x for x in spans if not any(m[0] == x[0] and m[2] and fits(m[3], x[4]) and (m[2] in x[3] or x[3] in m[2]) for m in notes)]
        mode = "strict" if strict else "lenient"
        o, h, d, f = len(places), sum(v is not None for v in hit.values()), len(spans), len(wrong)
        assert got[mode, "all", None, None, None] == (o, h, d, f, h / o, f / d)
        for kind in ("name", "email", "detail"):
            o, h = sum(p[2] == kind for p in places), sum(p[2] == kind and v is not None for p, v in hit.items())
            d, f = sum(x[4] == kind for x in spans), sum(x[4] == kind for x in wrong)
            assert got[mode, "type", kind, None, None] == (o, h, d, f, h / o if o else None, f / d if d else None)
        for rule in ("r1", "r2"):
            assert got[mode, "rule", None, rule, None][1:4] == (sum(v == rule for v in hit.values()), sum(x[5] == rule for x in spans), sum(x[5] == rule for x in wrong))
        assert sum(v[0] for key, v in got.items() if key[:2] == (mode, "type and lang")) == len(places) == sum(v[0] for key, v in got.items() if key[:2] == (mode, "lang"))
        total = score(n, s, strict).first()
        assert (total.occurrences, total.hits, total.detections, total.false_positives) == (len(places), sum(v is not None for v in hit.values()), len(spans), len(wrong))
        assert covered(occurrences(n), s, strict).count() == len(places) and unfounded(s, n, strict).count() == len(wrong)


def test_only_changed_texts_are_detected_again(spark):
    seen = []

    def find(rows):
        seen.append(rows.count())
        return rows.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))))

    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "bb")], "doc_id long, text string")
    memo, new = changes.refreshed(first, find=find)
    assert seen == [3] and new.count() == memo.count() == 3
    second = spark.createDataFrame([(1, "a"), (2, "changed"), (3, None), (5, "bb"), (6, "bb")], "doc_id long, text string")
    memo, new = changes.refreshed(second, memo, find=find)
    assert seen == [3, 1] and [r.digest for r in new.collect()] == [r.d for r in second.where("doc_id = 2").select(changes.text_digest(F.col("text")).alias("d")).collect()]
    assert {r.doc_id: r.spans[0].end for r in changes.remembered(second, memo).collect()} == {1: 1, 2: 7, 3: 0, 5: 2, 6: 2}
    assert changes.refreshed(second, memo, find=find)[1].count() == 0
    decisions = changes.remembered(first, memo).select("doc_id", "digest", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(False).alias("confirmed"))
    assert sorted(r.doc_id for r in changes.standing(decisions, second).collect()) == [1, 3, 5]


def test_term_search_agrees_with_the_pattern(spark):
    """As a case-insensitive search for the escaped term, on texts without special folds."""
    r = random.Random(6)
    for _ in range(40):
        text, term = "".join(r.choices("aAbBéÉ. ", k=50)), "".join(r.choices("abé.", k=2))
        assert sorted((a, b) for a, b, _ in places(fold_each(text), (fold_each(term),))) == [m.span() for m in re.finditer(re.escape(term), text, re.I)]
