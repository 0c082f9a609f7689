"""Byte-level BPE by rank files: encoding in length-bucketed numpy matrices, and decoding.

Encoding. A text is split into the matches of a pattern. The distinct matches of a batch become the rows of
padded matrices, one matrix for each bucket of lengths, with an id for each byte. In every round a row merges
its leftmost pair of the least rank: ranks come from a hash table of pairs (open addressing in numpy arrays, all
pairs of a matrix at once), `argmin` finds the first least one, the pair's place takes the merged id and the rest
of the row moves one place left. Only the two pairs beside it are looked up again. Rows without a pair of any
rank leave the matrix. A pair's rank is that of the token with its bytes, so any two tokens whose bytes make up a
token can merge, as in the rank files' own library.

A row of n bytes takes up to n rounds over n places. That is little below LONG bytes; longer matches (a line of
one letter, a megabyte without a blank) follow the same rule with a heap of pairs over a linked list, which takes
n log n steps.

Where the pattern is the usual one, texts are first cut at the places named in `encode`, and a bounded table of
distinct cuts supplies repeats. With any other pattern whole texts are split.

Defined cases: null and empty texts have no ids and decode to no bytes; texts of any length are encoded whole; strings
that look like special tokens are ordinary text; rows are independent, so repeated rows and ids, ties and rows
without an id give a row each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder, _Table
from .textkernel import gather, mix64, sub_batches

#: The pattern for which the cuts of `encode` are proved.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest match, in bytes, that is a row of a matrix, and the widths of the matrices.
LONG = 256
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)
#: Places of a matrix.
PLACES = 1 << 20
_U = np.uint64
_NONE = np.iinfo(np.int32).max
_FREE = np.iinfo(np.uint64).max
_LOADED: dict[tuple[str, str], RankEncoder] = {}


class Pairs:
    """A hash table from two neighbouring ids to the id that they merge to, which is also the pair's rank."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(2 * len(rank)).bit_length() + 1)  # a quarter full at most
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, _FREE, _U), np.full(1 << bits, _NONE, np.int32)
        keys = self._keys(a, b)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            place = at[left]
            free = self.keys[place] == _FREE
            first = np.zeros(len(left), bool)
            first[np.unique(place[free], return_index=True)[1]] = True  # among those that want a free slot
            take = np.flatnonzero(free)[first[: free.sum()]]
            self.keys[place[take]], self.ranks[place[take]] = keys[left[take]], rank[left[take]]
            stay = np.ones(len(left), bool)
            stay[take] = False
            left = left[stay]
            at[left] = (at[left] + 1) & self.mask

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(_U) << _U(32) | b.astype(_U)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE for pairs that never merge."""
        keys = self._keys(a, b)
        at = self._slots(keys)
        out = np.full(len(keys), _NONE, np.int32)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (there != _FREE)]
            at[left] = (at[left] + 1) & self.mask
        return out


class RankEncoder(Encoder):
    """A rank file (a base64 token and its id a line) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
        self.pattern, self.cuttable, self.longest_added = regex.compile(pattern), pattern == USUAL, 0
        self.kind = np.uint32
        self.bytes_ = np.frombuffer(b"".join(ids), np.uint8)
        self.widths, self.first = (np.zeros(max(ids.values()) + 1, np.int64) for _ in range(2))
        order = np.fromiter(ids.values(), np.int64, len(ids))
        self.widths[order] = [len(t) for t in ids]
        self.first[order] = np.cumsum(self.widths[order]) - self.widths[order]
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        split = [(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        self.pairs = Pairs(*np.array(split, np.int64).reshape(-1, 3).T)
        self.known = {(a, b): i for a, b, i in split}  # the same pairs for the heap
        self.table = _Table(self.kind)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return gather(self.bytes_, self.first[ids], self.widths[ids])

    def raw(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.texts(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def cuts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.texts([data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        seen: dict[str, int] = {}
        which, many = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.pattern.findall(text)
            many[k] = len(found)
            which += [seen.setdefault(m, len(seen)) for m in found]
        ids, counts = self.matches([m.encode() for m in seen])
        index = np.array(which, np.int64)
        first = np.cumsum(counts) - counts
        out = gather(ids, first[index], counts[index])
        total = np.concatenate([[0], np.cumsum(counts[index])])
        return out, np.diff(total[np.concatenate([[0], np.cumsum(many)])])

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each); words are the pattern's matches."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        base = self.single[np.frombuffer(b"".join(words), np.uint8)]
        at, counts = np.cumsum(sizes) - sizes, sizes.copy()
        out = base.astype(self.kind)  # a word has no more ids than bytes, and keeps its place until the end
        low = 1
        for width in WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(own), PLACES // width):
                rows = own[k : k + PLACES // width]
                inside = np.arange(width) < sizes[rows, None]
                grid = np.full((len(rows), width), -1, np.int64)
                grid[inside] = gather(base, at[rows], sizes[rows])
                counts[rows] = self._rounds(grid, sizes[rows])
                inside = np.arange(width) < counts[rows, None]
                out[(at[rows, None] + np.arange(width))[inside]] = grid[inside]
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = self._heap(base[at[i] : at[i] + sizes[i]])
            counts[i] = len(ids)
            out[at[i] : at[i] + len(ids)] = ids
        return gather(out, at, counts), counts

    def _rounds(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges the rows of a padded matrix in place; the number of ids left in each row."""
        counts, width = sizes.copy(), grid.shape[1]
        ranks = np.full((len(grid), width), _NONE, np.int32)  # of each place with its right neighbour
        both = np.arange(1, width) < counts[:, None]
        ranks[:, :-1][both] = self.pairs.find(grid[:, :-1][both], grid[:, 1:][both])
        live, now, r = np.arange(len(grid)), grid, ranks
        while len(live):
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            merge = best < _NONE
            if not merge.all():  # finished rows leave
                grid[live[~merge]] = np.pad(now[~merge], ((0, 0), (0, width - now.shape[1])), constant_values=-1)
                live, now, r, at, best = live[merge], now[merge], r[merge], at[merge], best[merge]
                if not len(live):
                    break
            counts[live] -= 1
            lines = np.arange(len(live))
            places = np.arange(now.shape[1] - 1)
            now[lines, at] = best
            now = np.take_along_axis(now, places + (places > at[:, None]), axis=1)
            r = np.take_along_axis(r, places + (places >= at[:, None]), axis=1)
            now, r = now[:, : int(counts[live].max())], r[:, : int(counts[live].max())]
            for side in (-1, 0):  # the pairs on both sides of the merged id
                left = at + side
                there = np.flatnonzero((left >= 0) & (left + 1 < counts[live]))
                r[there, left[there]] = self.pairs.find(now[there, left[there]], now[there, left[there] + 1])
                last = np.flatnonzero((left >= 0) & (left + 1 == counts[live]))
                r[last, left[last]] = _NONE
        return counts

    def _heap(self, word: np.ndarray) -> list[int]:
        """The same merges, for a long word: pairs by (rank, place), places in a linked list."""
        ids, n = word.tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self.known.get
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := known((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of both has merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := known((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (found, i, rank, ids[k]))
            p = before[i]
            if p >= 0 and (found := known((ids[p], rank))) is not None:
                heapq.heappush(heap, (found, p, ids[p], rank))
        return [x for x in ids if x >= 0]


def rank_encoder(path: str, pattern: str = USUAL) -> RankEncoder:
    """One encoder a worker process, file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankEncoder(path, pattern)
    return _LOADED[path, pattern]


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of the runs of values."""
    off = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def encode_bpe(docs: DataFrame, path: str, pattern: str = USUAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, text) -> key, n_tokens, ids: each text's ids, packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = rank_encoder(path, pattern)
        for batch in sub_batches(batches, "text"):
            ids, counts = tool.column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), _packed(ids.astype("<u4"), counts).cast(pa.binary())], [key, "n_tokens", "ids"])

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary")


def decode_bpe(encoded: DataFrame, path: str, pattern: str = USUAL, key: str = "doc_id") -> DataFrame:
    """encoded (key, n_tokens, ids as of `encode_bpe`) -> the same and decoded: the bytes that the ids stand for, none for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = rank_encoder(path, pattern)
        for batch in sub_batches(batches, "ids"):
            column = batch.column(2).fill_null(b"")
            _, off, data = column.buffers()
            at = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
            ids = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view("<u4").astype(np.int64)
            total = np.concatenate([[0], np.cumsum(tool.widths[ids])])
            yield pa.RecordBatch.from_arrays([*batch.columns, _packed(tool.decoded(ids), np.diff(total[(at - at[0]) // 4])).cast(pa.binary())], [key, "n_tokens", "ids", "decoded"])

    rows = encoded.select(key, "n_tokens", "ids")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def unpacked(ids: bytes | None) -> list[int]:
    """The ids of one packed value."""
    return np.frombuffer(ids or b"", "<u4").tolist()
