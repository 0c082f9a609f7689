"""Vectorised byte-level text routines shared by the corpus operators.

Every routine works on Arrow string buffers: the UTF-8 bytes of many documents lie one after
another in one numpy array, with an offset per document. Word boundaries of the contracts are
ASCII classes, so they can be found on bytes without decoding. Work is cut into pieces of a few
MB, so memory stays bounded whatever the batch or the longest document measures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the numpy routines (a longer document is a piece of its own).
PIECE_BYTES = 2 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The low 0, 1, ... 8 bytes of a little-endian word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Longer spans are hashed one by one with BLAKE2b.
LONG = 64


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table, true inside the given inclusive byte ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, count=n + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of rows of about `limit` bytes: (first row, end row, bytes, offsets)."""
    data, off = text_buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_bounds(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = word[data]
    edge = np.zeros(n + 1, bool)  # a document begins here
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as little-endian words (zeros follow the last byte)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time, each step through `mix64`; of BLAKE2b above LONG bytes.

    Spans may overlap. Two seeds give two unrelated hashes. Equal hashes do not prove equal bytes: see `same_spans`.
    """
    size = ends - starts
    out = mix64(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if not len(out):
        return out
    words = _eights(data)
    out = mix64(out ^ (words[starts] & _LOW[np.minimum(size, 8)]))
    live, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        out[live] = mix64(out[live] * _U(0x9FB21C651E98DF25) ^ (words[starts[live] + k] & _LOW[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of data has the bytes of the span beside it in other."""
    size = ends - starts
    good = size == other_ends - other_starts
    a, b = _eights(data), _eights(other)
    live, k = np.flatnonzero(good & (size <= LONG)), 0
    while len(live):
        left = _LOW[np.minimum(size[live] - k, 8)]
        equal = a[starts[live] + k] & left == b[other_starts[live] + k] & left
        good[live[~equal]] = False
        k += 8
        live = live[equal]
        live = live[size[live] > k]
    for i in np.flatnonzero(good & (size > LONG)).tolist():
        good[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return good


def span_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Small numbers for spans: equal exactly where the bytes are equal (hashes only find the candidates)."""
    _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    rank = back.astype(np.int64)
    odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[first[back]], ends[first[back]])) if len(rank) else rank
    others: dict[bytes, int] = {}
    for i in odd.tolist():
        rank[i] = others.setdefault(data[starts[i] : ends[i]].tobytes(), len(first) + len(others))
    return rank


def run_ranks(ranks: np.ndarray, words: int) -> np.ndarray:
    """Numbers for the runs of `words` neighbouring ranks, equal exactly where the runs are equal."""
    out = ranks
    for k in range(1, words):
        if len(out) < 2:
            return out[:0]
        after = ranks[k:]
        out = np.unique(out[:-1] * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
    return out


def gather(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenates ids[first : first + count] of all spans without a loop."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return ids[np.repeat(first - begin, count) + np.arange(total)]


def char_counts(data: np.ndarray) -> np.ndarray:
    """Prefix count of code points (bytes that do not continue one): n + 1 entries."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def sub_batches(batches: Iterator[pa.RecordBatch], name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about `limit` bytes each."""
    for batch in batches:
        _, off = text_buffers(batch.column(batch.schema.names.index(name)))
        at, n = 0, len(off) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def keep_rows(docs, judge):
    """The rows of a DataFrame whose text `judge` (a column -> a mask) accepts; all columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            yield batch.filter(pa.array(judge(batch.column(batch.schema.names.index("text")))))

    return docs.mapInArrow(run, docs.schema)
