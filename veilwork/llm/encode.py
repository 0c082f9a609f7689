"""Exact subword encoding at corpus scale.

A byte-level vocabulary with the usual word pattern always ends a pre-token at these places: before a
single blank between two characters that are no white space, before and after a single line feed
between such characters, and between an ASCII letter or digit and one of `.,;:!?`. Texts are cut
there only, so the ids of a text are the ids of its cuts, one after another. The library encodes each
distinct cut once (its merge loop is the expensive part) and a bounded table supplies the repeats. The
table is looked up by a 64-bit hash of a cut and compared by bytes, so equal hashes of different cuts do
no harm. Vocabularies with another normaliser or pattern are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .textkernel import gather, same_spans, span_hashes, text_buffers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LOADED: dict[str, Encoder] = {}
_SAFE = np.ones(256, bool)
_SAFE[:0x21] = _SAFE[0x7F] = False
#: First bytes of characters among which there is Unicode white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_AFTER = _SAFE & ~_WIDE
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Longest cut, in bytes, that the table keeps, and how many cuts it keeps.
KEEP_BYTES, KEEP = 64, 1_000_000
#: Cuts that are encoded as one text.
JOINED = 200


def cut_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending byte positions at which cuts begin: each non-empty document's start and each safe place."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
    gap = gap[(gap > 0) & (gap < n - 1)]
    gap = gap[~edge[gap] & ~edge[gap + 1] & _SAFE[data[gap - 1]] & _AFTER[data[gap + 1]]]
    high = data[gap - 1] >= 0x80
    wide = (data[gap - 2] == 0xC2) | _WIDE[data[gap - 3]]
    gap = gap[~(high & wide)]
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 0]
    mark = mark[~edge[mark] & _ALNUM[data[mark - 1]]]
    edge[gap] = edge[mark] = edge[gap[data[gap] == 0x0A] + 1] = True
    edge[n] = False
    return np.flatnonzero(edge)


class _Table:
    """Cuts and their ids, found by hash and compared by bytes; new keys gather in a small second level."""

    def __init__(self, kind: type) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.spans = [np.zeros((0, 4), np.int32), np.zeros((0, 4), np.int32)]  # first id, ids, first byte, byte after
        self.ids, self.bytes = np.zeros(0, self.kind), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(spans (first, count) of the cuts' ids, first is -1 for an unknown cut; whether the key is taken)."""
        out = np.full((len(keys), 2), -1, np.int64)
        taken = np.zeros(len(keys), bool)
        for level in (0, 1):
            if len(self.keys[level]):
                at = np.minimum(np.searchsorted(self.keys[level], keys), len(self.keys[level]) - 1)
                hit = np.flatnonzero(self.keys[level][at] == keys)
                taken[hit] = True
                found = self.spans[level][at[hit]]
                same = same_spans(data, starts[hit], ends[hit], self.bytes, found[:, 2], found[:, 3])
                out[hit[same]] = found[same, :2]
        return out, taken

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, cuts: np.ndarray) -> None:
        """Distinct new keys in ascending order, with the ids and the bytes of their cuts one after another."""
        if len(self.keys[0]) + len(self.keys[1]) + len(keys) > KEEP:
            self.clear()
        first, at = len(self.ids) + np.cumsum(counts) - counts, len(self.bytes) + np.cumsum(sizes) - sizes
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, cuts])
        self._merge(1, keys, np.stack([first, counts, at, at + sizes], axis=1).astype(np.int32))
        if len(self.keys[1]) > max(20_000, len(self.keys[0]) // 3):
            self._merge(0, self.keys[1], self.spans[1])
            self.keys[1], self.spans[1] = self.keys[1][:0], self.spans[1][:0]

    def _merge(self, level: int, keys: np.ndarray, spans: np.ndarray) -> None:
        keys = np.concatenate([self.keys[level], keys])
        order = np.argsort(keys, kind="stable")
        self.keys[level], self.spans[level] = keys[order], np.concatenate([self.spans[level], spans])[order]


class Encoder:
    """A vocabulary file of the tokenizers library, for many texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        added = spec.get("added_tokens", [])
        self.cuttable = plain and not any(set(" \n.,;:!?") & set(x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        self.longest_added = max([len(x["content"]) for x in added], default=0)
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.widths = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes that each id stands for
        if self.cuttable:
            for token, i in self.library.get_vocab().items():
                self.widths[i] = len(token)  # a byte-level token has a character for each byte
            for x in added:
                self.widths[x["id"]] = len(x["content"].encode())
        self.table = _Table(self.kind)

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all cuts one after another, number of ids of each cut).

        Cuts that begin with a blank and a plain character and end with an ASCII one are encoded many at a time: texts
        are cut between two such cuts, so their ids are those of their concatenation, told apart by the bytes they stand for.
        """
        sizes, counts = ends - starts, np.zeros(len(starts), np.int64)
        plain = (data[starts] == 0x20) & (sizes > 1)
        plain &= _AFTER[data[np.minimum(starts + 1, len(data) - 1)]] & _SAFE[data[ends - 1]] & (data[ends - 1] < 0x80)
        many, single = np.flatnonzero(plain), np.flatnonzero(~plain)
        text = gather(data, starts[many], sizes[many])
        stops = np.cumsum(sizes[many])
        marks = [0, *stops[JOINED - 1 :: JOINED].tolist(), *([int(stops[-1])] if len(stops) % JOINED else [])]
        parts = [text[a:b].tobytes().decode() for a, b in zip(marks, marks[1:], strict=False)]
        joined = np.fromiter(chain.from_iterable(self.raw(parts)), self.kind)
        reach = np.searchsorted(np.cumsum(self.widths[joined]), stops, "left") + 1
        counts[many] = np.diff(reach, prepend=0)
        alone = self.raw([data[a:b].tobytes().decode() for a, b in zip(starts[single].tolist(), ends[single].tolist(), strict=True)])
        counts[single] = np.fromiter(map(len, alone), np.int64, len(alone))
        first = np.zeros(len(starts), np.int64)
        first[many] = reach - counts[many]
        first[single] = len(joined) + np.cumsum(counts[single]) - counts[single]
        return gather(np.concatenate([joined, np.fromiter(chain.from_iterable(alone), self.kind)]), first, counts), counts

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); a null is an empty text."""
        data, off = text_buffers(column)
        if not self.cuttable:
            found = self.raw([bytes(data[a:b]).decode() for a, b in zip(off, off[1:], strict=False)])
            return np.array([x for ids in found for x in ids], self.kind), np.array([len(x) for x in found], np.int64)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(off) - 1, np.int64)
        starts = cut_starts(data, off)
        ends = np.append(starts[1:], len(data))
        keys, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[where[back]], ends[where[back]]))
        plain = len(keys)
        if len(odd):  # equal hashes of different bytes: each such cut stands for itself
            back[odd] = plain + np.arange(len(odd))
            where = np.concatenate([where, odd])
        s, e = starts[where], ends[where]
        spans = np.full((len(where), 2), -1, np.int64)
        spans[:plain], taken = self.table.find(keys, data, s[:plain], e[:plain])
        new = np.flatnonzero(spans[:, 0] < 0)
        ids = self.table.ids
        if len(new):
            fresh, counts = self.cuts(data, s[new], e[new])
            spans[new, 0], spans[new, 1] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.concatenate([ids, fresh])
            keep = e[new] - s[new] <= KEEP_BYTES
            keep[new >= plain] = False
            keep[keep] = ~taken[new[keep]]
            sizes = (e - s)[new[keep]]
            self.table.add(keys[new[keep]], counts[keep], fresh[np.repeat(keep, counts)], sizes, gather(data, s[new[keep]], sizes))
        spans = spans[back]
        owner = np.searchsorted(starts, off)  # first cut of each document
        total = np.concatenate([[0], np.cumsum(spans[:, 1])])
        return gather(ids, spans[:, 0], spans[:, 1]), np.diff(total[owner])


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
