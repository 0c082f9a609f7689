"""Rules, lists and columns: what they find in short texts, all in one job."""

import pytest
import regex
from pyspark.sql import functions as F

from veilwork.operators.detect import detect
from veilwork.operators.names import SEED_FAMILY, SEED_GIVEN, NameLists
from veilwork.operators.replace import anonymize, code_table, redact, reserved_tokens, restore, restore_flags

# text, what it holds as (type, value)
CASES = [
    ("mail jo.ö+x@exämple.co.uk, ok", [("email", "jo.ö+x@exämple.co.uk")]),
    ("full width a＠b.de", [("email", "a＠b.de")]),
    ("no mail: a@b", []),
    ("see https://e.org/a_(b)). And www.x.nl!", [("url", "https://e.org/a_(b)"), ("url", "www.x.nl")]),
    ("nl91 abna0417164300 22 x", [("iban", "nl91 abna0417164300")]),
    # its digits are also a phone number that crosses it
    ("nl91 abna 0417 1643 00 22 x", [("detail", "nl91 abna 0417 1643 00 22")]),
    ("ZZ91 ABNA0417164300", []),
    ("on 31/12/2024 and 2024-02-30, 29.02.2023, 12/31/2024", [("date", "31/12/2024"), ("date", "12/31/2024")]),
    ("3-4/2024 no, 4th March, 2026 yes, 31 June 2020, mei 5 2020 yes", [("date", "4th March, 2026"), ("date", "mei 5 2020")]),
    ("Sept. 3, 2019; 03-04-05; DOB: 03-04-49; dob 31.31.50", [("date", "Sept. 3, 2019"), ("date", "03-04-49")]),
    ("10.0.0.256 1.2.3.4.5 192.168.0.1 fe80::1 a::b::c 1:2:3:4:5:6:7:8", [("ip", "192.168.0.1"), ("ip", "fe80::1"), ("ip", "1:2:3:4:5:6:7:8")]),
    ("at 1234 ab, 0234 ab, 12/1234 ab", [("postcode", "1234 ab")]),
    ("BSN: 111222333; bsn on file 123456783; sofinummer #000000000", [("bsn", "111222333")]),
    ("12 Oak Lane; Groene Weg 5; kerkstraat 12-A; Laan van Nieuw Oost 7", [("address", "12 Oak Lane"), ("address", "Groene Weg 5"), ("address", "kerkstraat 12-A"), ("address", "Laan van Nieuw Oost 7")]),
    ("Adres: bij de kerk 5, achter\nHome address: flat nine\nWoonadres: boot 3 haven", [("address", "bij de kerk 5, achter"), ("detail", "boot 3 haven")]),
    ("call +31 (0)20 123 4567. or 0612345678, 061234567; (020) 555-1234", [("phone", "+31 (0)20 123 4567"), ("phone", "0612345678"), ("phone", "(020) 555-1234")]),
    ("student id AB12, student id ABCD, leerlingnummer 998877; staff 1234, staff: 1234A", [("detail", "AB12"), ("detail", "998877"), ("detail", "1234A")]),
    ("personeelsnummer: P-77/1", [("detail", "P-77/1")]),
    ("Bestandsnaam: my list\n notes for jo.pdf \nand b_2.XLSX here", [("filename", "my list"), ("filename", "notes for jo.pdf"), ("filename", "b_2.XLSX")]),
    ("open 'C:\\my docs\\x' or /home/jo/a b.txt or \\\\srv\\share\\f.", [("filename", "C:\\my docs\\x"), ("filename", "/home/jo/a b.txt"), ("filename", "\\\\srv\\share\\f")]),
    ("Anna Maria de Vries, smit, Smit Anna, TESS; Zoe-Lou, Maria lives", [("name", "Anna Maria de Vries"), ("name", "Smit Anna"), ("name", "TESS"), ("name", "Maria")]),
    ("Hello dear müller-lüdenscheidt ÉMILE and mullerludenscheidtemile, Émile 5 müller", [("name", "müller-lüdenscheidt ÉMILE"), ("name", "mullerludenscheidtemile"), ("name", "Émile")]),
    ("title\nName;B S N;dob\nx;111222333;01/02/03\n# x;1;2\n\"a;b\";111222333;31/31/03\nshort\nx;111222333;01/02/03", [("bsn", "111222333"), ("date", "01/02/03"), ("bsn", "111222333")]),
    ("id,Student-Number\n7,AB12\n8,nope\n9,\"C-3/4\"", [("detail", "AB12"), ("detail", "C-3/4")]),
    ("", []),
    (None, []),
    ("😀😀 10.0.0.1", [("ip", "10.0.0.1")]),
]


@pytest.fixture(scope="module")
def found(spark):
    lists = NameLists(SEED_GIVEN, SEED_FAMILY, [("Émile", "Müller-Lüdenscheidt")])
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return detect(docs, lists=lists).cache()


def test_cases(found):
    got = {r.doc_id: r for r in found.collect()}
    for i, (text, want) in enumerate(CASES):
        assert [(s.type, s.value) for s in got[i].spans] == want, text
        for s in got[i].spans:
            assert text[s.start : s.end] == s.value
        ends = [0, *(s.end for s in got[i].spans)]
        assert all(s.start >= e for s, e in zip(got[i].spans, ends, strict=False))


def test_ipv6_without_digits(spark):
    texts = ["host fe::ab", "dead:beef::cafe", "at :: or d::", "a: b: c"]
    got = detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.value for s in r.spans if s.type == "ip"] for r in got] == [["fe::ab"], ["dead:beef::cafe"], ["::", "d::"], []]


def test_codes_round_trip(found):
    text, spans, codes = F.coalesce("text", F.lit("")), F.col("spans"), F.col("codes")
    rows = found.withColumn("codes", code_table(text, spans)).withColumn("said", anonymize(text, spans, codes))
    rows = rows.select("text", "spans", "codes", "said", redact(text, spans).alias("removed"), restore(F.col("said"), codes).alias("back"), restore_flags(F.col("said"), codes, reserved_tokens(text)).alias("flags"))
    for r in rows.collect():
        assert r.back == (r.text or "") and r.flags == []
        want, at = "", 0
        for x in r.spans:
            want, at = want + r.text[at : x.start] + "[REMOVED]", x.end
        assert r.removed == want + (r.text or "")[at:]
        assert len({(c.type, c.original) for c in r.codes}) == len(r.codes) == len({c.pseudonym for c in r.codes})


def test_stack_survives_long_texts(spark):
    long = ["a" * 150_000, "a-" * 50_000 + "a", "a." * 60_000 + "b@" + "c." * 50_000 + "de", "x " * 60_000 + "straat 1", "9" * 120_000, "[[A_001]]" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    assert detect(docs).select(F.sum(F.size("spans"))).first()[0] >= 1


def test_marks_of_matching_may_stand_in_texts(spark):
    """The noncharacters that mark matches are text like any other; a group's value is cut from the text."""
    from veilwork.operators.matching import BEGIN, GROUP, STAND_IN, STOP, matches

    texts = ["a1 b22", f"{BEGIN}a1{GROUP}b{STOP}2 c3", f"x{STOP}{STAND_IN}9", "", "none", "é漢😀7 é8"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    pattern = r"[\p{L}\p{Cn}\p{So}]*(\d)"
    got = {r.i: [tuple(s) for s in r.s] for r in d.select("i", matches(F.col("t"), pattern).alias("s")).collect()}
    inner = {r.i: [tuple(s) for s in r.s] for r in d.select("i", matches(F.col("t"), pattern, 1).alias("s")).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), m.end(), m[0], m.start(1)) for m in regex.finditer(pattern, t)]
        assert got[i] == [x[:3] for x in found]
        assert inner[i] == [(p, p + 1, t[p]) for *_, p in found]


def test_lexicon_from_a_table(spark):
    rows = [("Anna", "given"), ("anna", "given"), ("Smit", "family"), (None, "given"), ("Ignored", "other"), ("Ito", "family")]
    lists = NameLists.from_table(spark.createDataFrame(rows, "name string, kind string"))
    assert (lists.given, lists.family) == (frozenset({"anna"}), frozenset({"smit", "ito"}))
    d = spark.createDataFrame([(1, "then Anna van der Smit spoke")], "doc_id long, text string")
    assert [s.value for s in detect(d, lists=lists, columns=False).first().spans] == ["Anna van der Smit"]
