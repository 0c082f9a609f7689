"""Benchmark decontamination: an FM-index per shard of documents, searched for all benchmark phrases.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A benchmark item's
phrases are its windows of `window` consecutive words; an item of fewer words is one phrase. A worker
takes documents in shards of about SHARD_BYTES of text and indexes each shard's word sequence: a word
that no phrase contains ends a run, and so does a document's end. Runs shorter than the shortest
phrase can hold no phrase and are left out of the index. Phrases are found by backward search, their
occurrences are located through sampled suffix positions, and their word spans are merged.

Documents never leave their task, so nothing is shuffled and no passage, however common, makes a hot
key. Phrases are broadcast in blocks of about BLOCK_BYTES of benchmark text, PASS_BYTES at a time; each
shard is searched for one block after another. A larger benchmark takes several passes, which go over few documents only:
the documents are read once, and a Bloom filter of FILTER_BITS over the word hashes of all phrases tells those that may hold
a phrase from those that hold none. What a pass found is written beside the former, its blocks are dropped, and the next
pass goes on from there. So neither a worker nor the driver holds more than the filter (16 MB) and the phrases of
PASS_BYTES (about 40 MB), whatever the benchmark's size; a fuller filter lets more documents through to the search,
which alone decides, and loses none.

Defined cases: null and empty texts have no words and no hits; a text of any length is a shard of its own if it
is larger than SHARD_BYTES; equal item ids are one item; a null item id is an item named `null`; an item without
words has no phrase; rows are independent, so repeated doc ids give a row each; an empty benchmark hits nothing;
empty tables give no rows; other columns are ignored or, in `keep_clean`, passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import discard, written
from .textkernel import ALNUM, LOWER, char_counts, gather, same_spans, span_hashes, span_ranks, sub_batches, text_buffers, word_bounds

SHARD_BYTES, BLOCK_BYTES, PASS_BYTES, FILTER_BITS, PROBES = 6 << 20, 1 << 20, 4 << 20, 1 << 27, 3
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = text_buffers(column)
    lower = LOWER[data]
    starts, ends, at = word_bounds(lower, off, ALNUM)
    return data, off, starts, ends, at, span_hashes(lower, starts, ends)


class Phrases:
    """The distinct phrases of a block of items, over the block's own vocabulary (symbols 1..)."""

    def __init__(self, items: list[str], texts: list[str | None], window: int) -> None:
        data, _, starts, ends, at, _ = _words(pa.array(texts, pa.string()))
        data = LOWER[data]
        _, first, rank = np.unique(span_ranks(data, starts, ends), return_index=True, return_inverse=True)
        starts, ends, self.seed = starts[first], ends[first], 0
        while len(np.unique(hashes := span_hashes(data, starts, ends, self.seed))) < len(first):
            self.seed += 1  # until the hash tells all words of the block apart
        order = np.argsort(hashes)
        #: Hashes of the words in ascending order, and where their bytes stand; words are symbols 1, 2, ... in that order.
        self.vocabulary, sizes = hashes[order], (ends - starts)[order]
        self.bytes, self.stops = gather(data, starts[order], sizes), np.cumsum(sizes)
        self.begins = self.stops - sizes
        symbols = np.argsort(order)[rank] + 1
        found: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for k, item in enumerate(items):
            own = symbols[at[k] : at[k + 1]]
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                part = own[i : i + window]
                found.setdefault(part.tobytes(), (part, set()))[1].add(item)
        self.lengths = np.array([len(x) for x, _ in found.values()], np.int64)
        self.rows = np.zeros((len(found), window), np.int32)
        for k, (part, _) in enumerate(found.values()):
            self.rows[k, window - len(part) :] = part
        self.items = [sorted(x) for _, x in found.values()]


    def lookup(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol - 1 of each word, whether the word is in the vocabulary: found by hash, compared by bytes)."""
        if self.seed:
            hashes = span_hashes(lower, starts, ends, self.seed)
        symbol = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[symbol] == hashes
        like = np.flatnonzero(known)
        known[like] = same_spans(lower, starts[like], ends[like], self.bytes, self.begins[symbol[like]], self.stops[symbol[like]])
        return symbol, known


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int, pass_bytes: int) -> Iterator[list]:
    """Broadcast phrases, in blocks of about block_bytes of benchmark text; a list of blocks for each pass, one at least."""
    spark, out, items, texts, size, held = benchmark.sparkSession, [], [], [], 0, 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        items.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if size >= block_bytes:
            out.append(spark.sparkContext.broadcast(Phrases(items, texts, window)))
            items, texts, size, held = [], [], 0, held + size
        if held >= pass_bytes:
            yield out
            out, held = [], 0
    if items:
        out.append(spark.sparkContext.broadcast(Phrases(items, texts, window)))
    yield out


class PhraseFilter:
    """A Bloom filter over the phrases of a whole benchmark; a phrase is known by its words' hashes."""

    def __init__(self, bits: int = FILTER_BITS) -> None:
        self.bits, self.shift, self.lengths = np.zeros(bits // 8, np.uint8), np.uint64(64 - (bits.bit_length() - 1)), set()

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """The bit of each key, for one probe after another."""
        for _ in range(PROBES):
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (keys >> self.shift).astype(np.int64)

    @staticmethod
    def _stretches(hashes: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, a key for the stretch of that many words from each word on, as far as words go)."""
        keys = np.zeros(len(hashes), np.uint64)
        for n in range(1, min(max(lengths, default=0), len(hashes)) + 1):
            keys = keys[: len(hashes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
            if n in lengths:
                yield n, keys

    def add(self, texts: list[str | None], window: int) -> None:
        *_, at, hashes = _words(pa.array(texts, pa.string()))
        sizes = np.diff(at)
        lengths = set(np.minimum(sizes[sizes > 0], window).tolist())
        self.lengths |= lengths
        for n, keys in self._stretches(hashes, lengths):
            item = np.searchsorted(at, np.arange(len(keys)), "right") - 1
            own = (np.arange(len(keys)) + n <= at[item + 1]) & (n == np.minimum(sizes[item], window))
            for place in self._places(keys[own]):
                np.bitwise_or.at(self.bits, place >> 3, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8)))

    def may_hold(self, column: pa.Array) -> np.ndarray:
        """Whether each text may hold a phrase; never False for one that does."""
        *_, at, hashes = _words(column)
        begins = np.zeros(len(hashes), bool)
        for _, keys in self._stretches(hashes, self.lengths):
            left = np.arange(len(keys))
            for place in self._places(keys):
                left = left[(self.bits[place[left] >> 3] >> (place[left] & 7).astype(np.uint8)) & 1 == 1]
            begins[left] = True
        return np.diff(np.concatenate([[0], np.cumsum(begins)])[at]) > 0


def phrase_filter(benchmark: DataFrame, window: int, block_bytes: int) -> PhraseFilter:
    """The filter of all phrases, filled from about block_bytes of benchmark text at a time."""
    out, texts, size = PhraseFilter(), [], 0
    for row in benchmark.select("text").toLocalIterator():
        texts.append(row[0])
        size += len(row[0] or "")
        if size >= block_bytes:
            out.add(texts, window)
            texts, size = [], 0
    out.add(texts, window)
    return out


def _occurrences(phrases: Phrases, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of each occurrence within the documents whose words begin at `at`."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return none, none
    symbol, known = phrases.lookup(lower, starts, ends, hashes)
    edge = np.zeros(len(hashes) + 1, bool)
    edge[at] = True
    begin = known.copy()
    begin[1:] &= ~known[:-1] | edge[1 : len(hashes)]
    stop = known.copy()
    stop[:-1] &= ~known[1:] | edge[1 : len(hashes)]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = last - first >= int(phrases.lengths.min())
    first, size = first[long], (last - first)[long]
    if not len(first):
        return none, none
    ahead = np.cumsum(size + 1) - size - 1  # each run's place in the sequence, its 0 included
    sequence = np.zeros(int((size + 1).sum()), np.int64)
    place = np.repeat(ahead - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    word = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    sequence[place] = symbol[word] + 1
    origin = np.zeros(len(sequence), np.int64)
    origin[place] = word
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    n = high - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return origin[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def _found(column: pa.Array, blocks: list, share: int, earlier: tuple[pa.Array, pa.Array] | None = None) -> dict[str, pa.Array]:
    """What the documents' texts hold; earlier: word stretches (within a text) and items that earlier passes found."""
    data, off, starts, ends, at, hashes = _words(column)
    lower = LOWER[data]
    docs, cover = len(column), np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for k, (stretches, names) in enumerate(zip(*(x.to_pylist() for x in earlier), strict=True) if earlier else ()):
        for x in stretches:
            cover[at[k] + x["word"]] += 1
            cover[at[k] + x["stop"]] -= 1
        items[k] = set(names)
    for block in blocks:
        phrases = block.value
        word, phrase = _occurrences(phrases, lower, starts, ends, hashes, at)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + phrases.lengths[phrase], -1)
        doc = np.searchsorted(at, word, "right") - 1
        for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
            items.setdefault(d, set()).update(phrases.items[p])
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_words, n_hit = np.diff(at), np.diff(total[at])
    edge = np.zeros(len(hashes) + 1, bool)
    edge[at] = True
    inner = ~edge[1 : len(hashes)] if len(hashes) else np.zeros(0, bool)
    begin, stop = hit.copy(), hit.copy()
    begin[1:] &= ~(hit[:-1] & inner)
    stop[:-1] &= ~(hit[1:] & inner)
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    chars = char_counts(data)
    doc = np.searchsorted(at, begin, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(chars[starts[begin]] - chars[off[doc]]), pa.array(chars[ends[stop]] - chars[off[doc]])], ["start", "end"])
    lists = [sorted(items.get(k, ())) for k in range(docs)]
    edges = pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32())
    stretches = pa.StructArray.from_arrays([pa.array(begin - at[doc]), pa.array(stop + 1 - at[doc])], ["word", "stop"])
    return {
        "n_words": pa.array(n_words),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(x) for x in lists], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
        "contaminated": pa.array((n_hit > 0) & (share * n_hit >= n_words)),
        "spans": pa.ListArray.from_arrays(edges, spans),
        "__hits": pa.ListArray.from_arrays(edges, stretches),
        "__items": pa.array(lists, pa.list_(pa.string())),
    }


def _sifted(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The documents that may hold a phrase, and those that hold none; both read one written copy, so `docs` is computed once."""
    told = docs.sparkSession.sparkContext.broadcast(phrase_filter(benchmark, window, block_bytes))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told.value.may_hold(batch.column("text")))], [*batch.schema.names, "__maybe"])

    rows = written(docs.mapInArrow(sift, docs.withColumn("__maybe", F.lit(True)).schema), "sifted")
    told.unpersist()
    return rows.where("__maybe").drop("__maybe"), rows.where("not __maybe").drop("__maybe")


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, share: int, block_bytes: int, pass_bytes: int, last) -> DataFrame:
    """`last` (batch, what was found) -> a batch, over the documents when all passes are made. docs has a column text."""
    passes = phrase_blocks(benchmark, window, block_bytes, pass_bytes)
    blocks = next(passes)
    rows, columns, clear, done = docs, docs.columns, None, []
    for following in passes:
        if clear is None:
            rows, clear = _sifted(docs, benchmark, window, block_bytes)
            rows = rows.withColumn("__hits", F.expr("cast(array() as array<struct<word: long, stop: long>>)")).withColumn("__items", F.expr("cast(array() as array<string>)"))

        def run(batches: Iterator[pa.RecordBatch], blocks: list = blocks) -> Iterator[pa.RecordBatch]:
            for batch in sub_batches(batches, "text", SHARD_BYTES):
                found = _found(batch.column("text"), blocks, share, (batch.column("__hits"), batch.column("__items")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), found["__hits"], found["__items"]], [*columns, "__hits", "__items"])

        rows = written(rows.mapInArrow(run, rows.schema), "searched")
        for block in blocks:
            block.unpersist()
        discard(*done)
        blocks, done = following, [rows]

    def end(blocks: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sub_batches(batches, "text", SHARD_BYTES):
                earlier = (batch.column("__hits"), batch.column("__items")) if "__hits" in batch.schema.names else None
                yield last(batch, _found(batch.column("text"), blocks, share, earlier))

        return run

    out = rows.mapInArrow(end(blocks), docs.schema if last is _clean else RESULT)
    if clear is None:
        return out
    return out.unionByName(clear if last is _clean else clear.mapInArrow(end([]), RESULT))


def _clean(batch: pa.RecordBatch, found: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in ("__hits", "__items")]
    return batch.select(names).filter(pa.compute.invert(found["contaminated"]))


def _told(batch: pa.RecordBatch, found: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RESULT.split(", ")[1:7]]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(found[n] for n in names)], ["doc_id", *names])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document.

    n_hit: words inside any occurrence of a phrase; n_items: items with an occurring phrase;
    items_sha256: of their ids, sorted as strings and joined by commas; contaminated: some word is hit
    and share * n_hit >= n_words; spans: the merged removal spans, in code points.
    """
    return _searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, share, block_bytes, pass_bytes, _told)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, without a shuffle."""
    return _searched(docs, benchmark, window, share, block_bytes, pass_bytes, _clean)


def without_spans(text, spans):
    """The text column with the spans (ascending, disjoint) cut out; an expression, for use on a join of both."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        spans,
        start,
        lambda done, s: F.struct(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))).alias("out"), s["end"].alias("at")),
    )
    return F.concat(cut["out"], F.substring(text, (cut["at"] + 1).cast("int"), F.lit(2**31 - 1)))
