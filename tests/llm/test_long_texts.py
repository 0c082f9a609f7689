"""Long texts made to be slow: time linear in the text, and the same findings as in short ones."""

import time

import pyarrow as pa
import pytest

from veilwork.llm.licenses import HEADERS, TEMPLATES, WHOLE, Judge, unmarked
from veilwork.llm.secrets import candidates, features


@pytest.mark.parametrize("unit", ["token", "token:", "token ", 'token="', "secret=a1b2c3d4e5f6g7h8\n", "-----BEGIN PRIVATE KEY-----\nabcdefghijklmnopqrst\n", "auth: Bearer "])
def test_candidates_of_long_texts(unit):
    text = unit * (500_000 // len(unit))
    began = time.time()
    found = candidates(pa.array([text]))
    assert time.time() - began < 20
    few = candidates(pa.array([unit * 50]))
    assert (len(few) > 5) == (len(found) > 1000)
    for _, a, b, value, *_ in found[:50]:
        assert text[a:b] == value and features(value, "", "", "")


def test_a_value_behind_names_in_a_run():
    texts = ["token: token: password=abcd1234", "authtoken=secretkey==abcd1234", 'secret = "a b c d"', "auth: Bearer abc", "apikey " + "x" * 30]
    got = [sorted(v for _, _, _, v, *_ in candidates(pa.array([t]))) for t in texts]
    assert [g[-1:] for g in got] == [["abcd1234"], ["abcd1234"], ["a b c d"], ["Bearer"], ["x" * 30]], got


def test_licenses_of_long_texts():
    judge = Judge(TEMPLATES, WHOLE, HEADERS, 0.6, 0.75)
    for text, name in (("license " * 30_000, None), ("license x\n" * 30_000, None), ("license" + " " * 300_000 + "x", None), ("filler words " * 20_000 + "Released under the MIT License.", "MIT")):
        began = time.time()
        assert judge(text)[0] == name and time.time() - began < 20


def test_sliding_counts_equal_counting_each_stretch():
    from veilwork.llm.licenses import _KEY, Templates, terms

    known = Templates(TEMPLATES)
    line = "this work is Licensed under the MIT License. and under the Apache License, Version 2.0. or Released under the MIT License. x y license license"
    words, top = line.split(), (None, 0.0)
    for i in (i for i, w in enumerate(words) if _KEY.search(w)):
        for name, size, vector in known.vectors:
            for begin in range(max(0, i - size + 1), i + 1):
                score = round(sum(w * vector.get(t, 0.0) for t, w in known._unit(terms(" ".join(words[begin : begin + size]))).items()), 6)
                top = (name, score) if score > top[1] else top
    assert known.line(line) == top and top[1] == 1.0


def test_marks_of_lines():
    assert unmarked("// a */ \n<!-- b -->\n  # c  \nd\r\n/* e") == "a\nb\nc  \nd\r\ne"
