"""Results do not rest on hashes: words that many hashes confuse, and a hash that confuses nearly everything."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import base_counts, brute_hits, docs, shingles
from veilwork.llm import encode, near_dup, textkernel
from veilwork.llm.decontaminate import contamination
from veilwork.llm.encode import Encoder, encoder
from veilwork.llm.near_dup import exact_sets, near_duplicates, shingle_sets
from veilwork.llm.quality import base_counts as fast_counts
from veilwork.llm.quality import quality
from veilwork.llm.queries import vocabulary
from veilwork.llm.textkernel import span_ranks
from veilwork.llm.token_counts import token_counts
from veilwork.llm.token_files import token_files


def pair(n):
    """Two words of n letters that are equal for polynomial hashes modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def confusing(spark):
    made = []
    for k, n in enumerate((512, 1024, 2048, 4096)):
        a, b = pair(n)
        made += [(10 * k + 1, f"x{k} {a} y{k}", "s"), (10 * k + 2, f"x{k} {b} y{k}", "s"), (10 * k + 3, f"{a}\n{b}\n{a} {b}", "s"), (10 * k + 4, f"{a} {b} {b} {a} {b}", "s")]
    return made, docs(spark, made)


def test_tokens_of_confusing_words(confusing):
    made, d = confusing
    tool = encoder(vocabulary())
    want = {i: tool.raw([t])[0] for i, t, _ in made}
    assert {r.doc_id: r.n_tokens for r in token_counts(d, vocabulary()).collect()} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in token_files(d, vocabulary(), 2).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_sets_counts_and_hits_of_confusing_words(spark, confusing):
    made, d = confusing
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(d, 2, 80).collect()}
    assert got == {i: (len(shingles(t, 2)), i) for i, t, _ in made}
    counted = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(d, None).collect()}
    assert counted == {i: base_counts(t) for i, t, _ in made}
    a, b = pair(1024)
    bench = spark.createDataFrame([(1, a), (2, f"{b} {a}")], "item_id long, text string")
    phrases = {(a,): {"1"}, (b, a): {"2"}}
    assert {r.doc_id: tuple(r)[1:5] for r in contamination(d, bench).collect()} == {i: brute_hits(t, phrases) for i, t, _ in made}


@pytest.fixture
def poor_hash(monkeypatch):
    """Every word's hash is its length modulo 3."""
    poor = lambda data, starts, ends, seed=0: ((ends - starts) % 3).astype(np.uint64) + np.uint64(seed)
    for module in (textkernel, encode):
        monkeypatch.setattr(module, "span_hashes", poor)
    monkeypatch.setattr(near_dup, "_hashes", lambda digests: (digests[:, 0] % 3).astype(np.uint64))


def test_a_poor_hash_changes_no_exact_result(poor_hash):
    words = "one three seven eleven of off a b seven one a longer-word-than-eight-bytes another-word-of-such-length".split() + ["z" * 70, "y" * 70, "z" * 70]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = textkernel.word_bounds(data, np.array([0, len(data)]), textkernel.NON_SPACE)
    ranks = span_ranks(data, starts, ends).tolist()
    assert all((ranks[i] == ranks[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    texts = ["the cat sat on the mat. A cat, too", "the cat sat\non the mat", None, "sat", "cat the sat", "the cat sat on the mat. A cat, too"]
    tool = Encoder(vocabulary())
    for _ in range(2):
        ids, counts = tool.column(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == tool.raw([t or "" for t in texts])
    sets = exact_sets(pa.array(texts), 2)
    assert [len(x) for x in shingle_sets(pa.array(texts), 2)] == [len(x) for x in sets]
    for k, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[k], sets[j])) == len(shingles(a, 2) & shingles(b, 2))
    lines = "a b c\nd e f\na b c\nx y z a b c d e f"
    assert tuple(int(x[0]) for x in fast_counts(pa.array([lines])).values()) == base_counts(lines)


def test_sets_have_the_size_of_brute_force_sets():
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["A", "bb", "a", "é", "ccc"], int(n))) for n in r.integers(0, 30, 200)] + [None, ""]
    for words in (1, 2, 5):
        column = pa.array(texts)
        want = [len(shingles(t, words)) for t in texts]
        assert [len(x) for x in exact_sets(column, words)] == want == [len(x) for x in shingle_sets(column, words)]


def test_words_pattern():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1fb\x0bc") == ["a\x1fb", "c"]


#: Two words with one hash under a hash of eight bytes a step without a key.
TWINS = "aaaaaaaabbbbbbbb", 'fpttvg1b.$[$i",9'


def test_words_made_to_collide_keep_their_shingles(spark):
    a, b = TWINS
    rows = [(1, f"x {a} x", "s"), (2, f"x {a} x {b}", "s"), (3, f"x {b} x", "s"), (4, f"x  {a.upper()} x", "s"), (5, f"x {a} x {a} x", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), 2, 80).collect()}
    assert got == {1: (2, 1), 2: (3, 2), 3: (2, 3), 4: (2, 1), 5: (2, 1)}  # 5: the set of 1, in other words
    long = [(i, " ".join([f"w{k} {a}" for k in range(6)] + [f"w{k} {x}" for k in range(6)]), "s") for i, x in ((1, a), (2, b))]
    kept = {r.doc_id for r in near_dup.distinct_texts(docs(spark, long)).collect()}
    one, two = (shingles(t, 5) for _, t, _ in long)
    assert kept == ({1, 2} if 100 * len(one & two) < 80 * len(one | two) else {1})


def test_sets_under_a_hash_of_three_values(monkeypatch):
    monkeypatch.setattr(near_dup, "_hashes", lambda digests: (digests[:, 0] % 3).astype(np.uint64))
    texts = [" ".join(f"w{(i * k) % 17}" for i in range(60)) for k in range(1, 12)] + ["", "one", "a b", None]
    for words in (1, 2, 5):
        found = list(near_dup.keyed_sets(pa.array(texts), words))
        assert [len(x) for x, _ in found] == [len(shingles(t or "", words)) for t in texts]
        assert all((np.diff(x.astype(object)) >= 0).all() for x, _ in found)
        assert len({k for _, k in found}) == len({tuple((t or "").split()) for t in texts})
