import gzip
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwork.llm.encode import Encoder, encoder
from veilwork.llm.fm_index import FMIndex
from veilwork.llm.queries import vocabulary
from veilwork.llm.repair import Block, lengths, pack
from veilwork.llm.textkernel import ALNUM, LOWER, NON_SPACE, pieces, span_hashes, text_buffers, word_bounds
from veilwork.llm.token_counts import encode_long
from veilwork.llm.warc import LoserTree, members, merge_order, record, url_key

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.#'漢😀\x0b\x1f\x00 ", max_size=30)), max_size=12)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for word, pattern in ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, off = text_buffers(pa.array(texts, pa.string()))
        if pattern.startswith(r"[^\x00"):
            data = LOWER[data]
        starts, ends, at = word_bounds(data, off, word)
        for k, text in enumerate(texts):
            own = [bytes(data[a:b]).decode() for a, b in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], strict=True)]
            text = text or ""
            if word is ALNUM:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            assert own == re.findall(pattern, text)


def test_equal_spans_have_equal_hashes_in_any_place():
    words = [f"w{i % 50}" for i in range(3000)]
    data, off = text_buffers(pa.array([" ".join(words)]))
    s, e, _ = word_bounds(data, off, NON_SPACE)
    a, b = span_hashes(data, s, e), span_hashes(data, s, e, 1)
    assert not (a == b).any()
    assert len({*a.tolist()}) == 50
    assert all(x == a[words.index(w)] for w, x in zip(words, a, strict=True))


def test_pieces_cover_all_rows():
    texts = ["x" * n for n in (0, 5, 100, 3, 0, 7)]
    assert [r for a, b, *_ in pieces(pa.array(texts), 10) for r in range(a, b)] == list(range(6))
    assert list(pieces(pa.array([], pa.string()))) == []


@pytest.fixture(scope="module")
def tool() -> Encoder:
    return encoder(vocabulary())


def test_cut_texts_encode_as_whole_texts(tool):
    r = random.Random(1)
    parts = [",", ".", "?", "a", "T", "\n", "B", " ", "  ", "\t", "'s", "'", " ", "é", "ß", "1", "23", "<|endoftext|>", "<|end", "!", "...", " ", "　", "漢", "😀", "\x85", "\x1c", "\r\n", " "]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(1500)]
    for _ in range(2):  # the second time from the table
        ids, counts = tool.column(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, want in enumerate(tool.raw([t or "" for t in texts])):
            assert ids[at[k] : at[k + 1]].tolist() == want


@pytest.mark.parametrize("window,overlap", [(50, 8), (100, 16), (1000, 64)])
def test_spliced_windows_equal_the_whole(tool, window, overlap):
    r = random.Random(2)
    mixed = "".join(r.choice(["word ", "x", "\n\n", "  ", "<|endoftext|>", "漢", "don't ", "12,5 "]) for _ in range(3000))
    for text in (mixed, "q" * 3000, "\n" * 500 + " " * 700, "b" * 900 + " c" * 200, "x"):
        assert encode_long(tool, text, window, overlap).tolist() == tool.raw([text])[0]


@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_grammar_round_trip_and_random_access(docs):
    docs = [d * 20 for d in docs]  # so that pairs repeat
    ids, counts = np.array([x for d in docs for x in d], np.uint32), np.array([len(d) for d in docs])
    block = Block(pack([None, *range(len(docs) - 1)], counts, ids, 6))
    assert block.all().tolist() == ids.tolist()
    assert block.doc_ids == [None, *range(len(docs) - 1)]
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d
    for a, b in ((0, 1), (3, 17), (len(ids) - 2, len(ids)), (5, 5), (0, len(ids) + 9)):
        assert block.tokens(a, b).tolist() == ids[max(0, a) : b].tolist()


def test_grammar_leaves_no_pair_that_pays():
    ids = np.tile(np.array([1, 2, 3, 4], np.uint32), 500)
    block = Block(pack([1], np.array([2000]), ids, 10))
    assert len(block.symbols) < 12 and block.lengths.max() >= 256
    r = np.random.default_rng(4)
    ids = r.zipf(1.3, 60_000).clip(max=65_000).astype(np.uint32)
    raw = pack([1, 2], np.array([30_000, 30_000]), ids, 65_001)  # symbols above 16 bits
    block = Block(raw)
    assert block.all().tolist() == ids.tolist() and len(raw) < 2 * len(ids)
    assert block.lengths.tolist() == lengths(block.rules, 65_001).tolist() and block.rules.max() >= 65_001
    left = np.stack([block.symbols[:-1], block.symbols[1:]], axis=1)
    left = np.delete(left, int(block.sizes[0]) - 1, axis=0)  # no pair crosses documents
    left = left[left[:, 0] != left[:, 1]]
    assert np.unique(left, axis=0, return_counts=True)[1].max() < 8  # pairs that overlap others may be left


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_fm_index_finds_all_occurrences(runs, pattern):
    sequence = np.array([x for r in runs for x in [*r, 0]])
    index = FMIndex(sequence, 4)
    row = np.zeros((1, 5), np.int64)
    row[0, 5 - len(pattern) :] = pattern
    low, high = index.search(row, np.array([len(pattern)]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(sequence)) if sequence[i : i + len(pattern)].tolist() == pattern]


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=8).map(sorted), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges_sorted_runs(runs):
    flat, spans = [], []
    for run in runs:
        spans.append((len(flat), len(flat) + len(run)))
        flat += run
    order = merge_order(lambda i: (flat[i],), spans)
    assert sorted(order.tolist()) == list(range(len(flat)))
    assert [flat[i] for i in order] == sorted(flat)
    assert LoserTree([(1,)], lambda a, b: a < b).winner == 0


def test_warc_records_follow_lengths():
    raw = b"WARC/1.1\r\nA: b\r\nContent-Length: 8\r\n\r\n\r\n\r\nWARC\r\n\r\n"
    head, block = record(raw)
    assert (head["A"], block) == ("b", b"\r\n\r\nWARC")
    for bad in (b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabcdef", b"", b"x\r\n\r\n"):
        with pytest.raises(ValueError):
            record(bad)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_gzip_members_are_found_in_a_stream(chunk):
    parts = [b"", b"a" * 1000, b"xyz", b"\x1f\x8b" * 50]
    packed = [gzip.compress(x) for x in parts]
    found = list(members(io.BytesIO(b"".join(packed)), chunk))
    assert [x for *_, x in found] == parts and [n for _, n, _ in found] == [len(x) for x in packed]
    assert found[2][0] == len(packed[0]) + len(packed[1])
    with pytest.raises(ValueError):
        list(members(io.BytesIO(packed[1][:-3]), chunk))


def test_url_keys():
    assert url_key("HTTP://www.Example.org/A?B=1#c") == "org,example)/a?b=1"
    assert url_key("") == ")/"
