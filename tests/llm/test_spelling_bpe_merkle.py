import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from veilwork.llm import merkle
from veilwork.llm.bpe import LONG, decode_bpe, encode_bpe, rank_encoder, unpacked
from veilwork.llm.merkle import document_manifest
from veilwork.llm.queries import vocabulary
from veilwork.llm.spelling import near_words, spelling_variants, word_counts

DOCS = "doc_id long, source string, lang string, n_chars long, text string, word string, leaf string, ids string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "w", "l", "i", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, a long text, clashing columns."""
    prose = "Spelling spellings speling Spelling spelling, SPELLING grösser größer größer"
    rows = [(1, None, None, None, None), (2, "a", "en", 0, ""), (3, "a", "en", 3, " \n\t"), (4, "b", "de", 9, prose), (4, "b", "de", 9, prose), (4, "b", "de", 9, "other"), (None, "a", "en", 1, prose)]
    rows += [(k, "hot", "en", k, f"{prose} {k} <|endoftext|> 漢字 #") for k in range(5, 90)] + [(90, None, "", 2, "x" * 3000 + " " + "longword " * 4000)]
    return docs(spark, rows)


def plain_counts(rows, slip=31):
    low, out = {k: k + 32 for k in range(65, 91)}, Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            word, run = run.translate(low), ""
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if word and slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_near_words_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abcé", k=rnd.randint(7, 9))) for _ in range(700)} | {"a" * 7, "a" * 8, "a" * 9, "abababab", "babababa", "ababababa", "é" * 7}
    words = {w: rnd.randint(2, 400) for w in words}
    got = {(r.word, r.n, r.near, r.near_n) for r in near_words(spark.createDataFrame([*words.items()], "word string, n long")).collect()}
    want = {(a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b)}
    assert got == want and len(want) > 100


def test_spelling_variants(spark, odd):
    words = plain_counts([(r.doc_id, r.text) for r in odd.collect()])
    got = {r.word: r for r in spelling_variants(odd, slip=31).collect()}
    assert got.keys() == words.keys()
    form = {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        r = got[w]
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    assert form


def test_roots_of_chains_and_a_word_of_many_letters(spark):
    rows = [(k, "s", "en", 0, "abcdefgh " * 2) for k in range(1)] + [(k, "s", "en", 0, "abcdefgx " * 20) for k in range(2)] + [(9, "s", "en", 0, "abcdefyx " * 500 + ("q" * 20_000 + " ") * 2 + ("q" * 20_001 + " ") * 2)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling_variants(docs(spark, rows), slip=0).collect()}
    assert got["abcdefgh"] == ("abcdefgx", "abcdefyx", 1) and got["abcdefgx"] == ("abcdefyx", "abcdefyx", 2)
    assert got["q" * 20_000] == (None, "q" * 20_000, 1)
    none = docs(spark, [])
    assert spelling_variants(none).collect() == [] and word_counts(docs(spark, [(1, None, None, None, None)])).collect() == []


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matrices_merge_as_the_library(library):
    rnd = random.Random(1)
    tool = rank_encoder(vocabulary("byte_bpe_50k.tiktoken"))
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 17, 31, 64, 100, LONG - 1, LONG, LONG + 1, 900]
    words = [bytes(rnd.choices(alphabet, k=rnd.choice(sizes))) for alphabet in (range(256), b"aeitnrsl ", b"ab", b"=-") for _ in range(400)]
    ids, counts = tool.matches(words)
    for word, found in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert found.tolist() == library._core_bpe.encode_single_piece(word)
    assert tool.decoded(ids.astype(np.int64)).tobytes() == b"".join(words)


def test_texts_encode_as_the_library_and_decode(spark, odd, library):
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    for pattern in (None, r"\p{L}+|[^\p{L}]+"):  # the second is encoded without cuts
        more = [pattern] if pattern else []
        tool = library if not pattern else tiktoken.Encoding("p", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
        got = Counter((r.doc_id, r.n_tokens, tuple(unpacked(r.ids)), bytes(r.decoded)) for r in decode_bpe(encode_bpe(odd, ranks, *more), ranks, *more).collect())
        want = Counter((r.doc_id, len(ids), tuple(ids), (r.text or "").encode()) for r in odd.collect() for ids in [tool.encode_ordinary(r.text or "")])
        assert got == want
    assert decode_bpe(encode_bpe(docs(spark, []), ranks), ranks).collect() == []
    assert decode_bpe(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary"), ranks).first().decoded == b""


def test_long_hostile_texts_encode_in_little_time(library):
    tool = rank_encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for text in ("a" * 200_000, "xyzzy漢" * 20_000, " " * 100_000 + "\n" * 100_000):
        ids, counts = tool.column(pa.array([text]))
        assert ids.tolist() == library.encode_ordinary(text) and counts.tolist() == [len(ids)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """{(doc_id, leaf): the other columns}, by lists of levels."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            first = i // 8 * 8
            yield level[first:i], level[i + 1 : first + 8]
            i //= 8

    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(levels([leaf(r, r.text) for r in groups[lang]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            steps = [*path(trees[g], i), *path(top, g)]
            touched = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text) if touched and r.text else r.text
            node = leaf(r, text)
            for left, right in steps:
                node = H(*left, node, *right)
            out.append((r.doc_id, trees[g][0][i], trees[g][-1][0], top[-1][0], H(*(x for s in steps for side in s for x in side)), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_equals_levels_by_hand(odd, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8**depth)
    got = Counter(tuple(r) for r in document_manifest(odd).collect())
    assert got == brute_manifest(odd.collect())
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_and_of_no_rows(spark):
    one = docs(spark, [(7, None, "x", None, "Ab")])
    row = document_manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()
    assert document_manifest(docs(spark, [])).collect() == []


def test_manifest_spreads_a_group_of_all_rows(spark):
    rows = docs(spark, [(k, "s", "en", 1, str(k)) for k in range(1100)]).withColumn("doc_id", F.when(F.col("doc_id") > 400, F.col("doc_id")))
    assert Counter(tuple(r) for r in document_manifest(rows).collect()) == brute_manifest(rows.collect())
