"""Token counts by overlap resynchronisation.

A document above `HUGE_BYTES` bytes is cut into windows that overlap. Each window is encoded by
itself, with offsets. Two neighbouring windows are spliced at a boundary between pre-tokens that both
of them show at the same character, at least MARGIN characters before the first window's end.

Why that is exact: the pre-tokeniser scans from left to right and keeps no state but its position, so
from a shared boundary on both windows continue alike, and the first window, which is right up to its
own splice, sees every character that can decide a boundary that far from its end (the pattern looks
one character ahead, an added token is shorter than MARGIN). By induction all windows agree with the
whole text between their splices. If no shared boundary exists, the overlap is doubled and the first
window encoded again, until one is found or it reaches the end of the document.

A document up to that size is encoded by `encode`, which gives the same ids; the tests count the same texts both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder, encoder
from .textkernel import sub_batches

HUGE_BYTES = 32_768
WINDOW, OVERLAP = 16_384, 256


def _bounds(found, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters at which pre-tokens begin, and the index of the token there."""
    words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    at = np.flatnonzero(new)
    return base + np.array(found.offsets, np.int64)[at, 0], at


def encode_long(tool: Encoder, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a long text, spliced from overlapping windows; equal to encoding it whole."""
    n, out = len(text), []
    margin = 2 * tool.longest_added + 8
    begin, done = 0, 0  # the window's first character; ids before `done` (a character) are out already
    while True:
        wide = overlap
        while True:
            end = min(n, begin + window + wide)
            left = tool.library.encode(text[begin:end], add_special_tokens=False)
            places, index = _bounds(left, begin)
            first = int(index[np.searchsorted(places, done)]) if len(places) and done <= places[-1] else len(left.ids)
            if end == n:
                return np.concatenate([*out, np.array(left.ids[first:], np.int64)])
            there = begin + window
            right = tool.library.encode(text[there : min(n, there + wide + margin)], add_special_tokens=False)
            common = np.intersect1d(places[(places > done) & (places <= end - margin)], _bounds(right, there)[0])
            if len(common):
                break
            wide *= 2
        splice = int(common[-1])
        out.append(np.array(left.ids[first : int(index[np.searchsorted(places, splice)])], np.int64))
        begin, done = there, splice


def token_counts(docs: DataFrame, path: str, limit: int = 512, huge_bytes: int = HUGE_BYTES, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; one row per input row.

    Null and empty texts count 0. Texts of any length are counted whole. Rows are independent (repeated ids and rows
    give a row each), an empty table gives no rows, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in sub_batches(batches, "text", 4 << 20):
            column, counts = batch.column(2), np.zeros(len(batch), np.int64)
            sizes = batch.column(1).to_numpy()
            huge = sizes > huge_bytes
            if not huge.all():
                counts[~huge] = tool.column(column.filter(pa.array(~huge)))[1]
            for i in np.flatnonzero(huge):
                counts[i] = len(encode_long(tool, column[i].as_py(), window, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
