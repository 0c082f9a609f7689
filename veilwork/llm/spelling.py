"""Spelling variant grouping by a rare-first prefix filter on positional bigrams.

Words are counted over all documents; those that are long and frequent enough make the table of words. A word's
bigrams are put in one global order: rare bigrams first (by the number of places in the table of words), then by
the bigram, then by place. One edit breaks at most two bigrams of a word, so two words that differ by one edit both
have, among their three first bigrams, the first one of those that the edit leaves whole: bigrams that are left
whole keep their order, and at most two others come before. Only these three are joined.

Position limits. The shared bigram lies either before the edit, so the words agree up to its end, or behind it, so
they agree from its begin on. The rest of the word on the other side of the bigram is cut in PARTS parts, of which
the edit touches one: the others agree too. The join key is what agrees (the shorter word's length, a prefix and a
suffix, hashed), so a bucket holds words that differ in one part of a word's one side only, however common the
bigram is. A word stands in it as the shorter one (or one of two of equal length) and, under the length of words
one shorter, as the longer one. Every candidate is verified by the edit distance of the words themselves.

A word's form is its near word with the largest count, if that is FACTOR times its own or more. Counts grow by that
factor along forms, so chains are short and end; roots are found by doubling.

Defined cases: null and empty texts have no words; words of any length are handled whole; a null doc_id reads as an
empty string; repeated rows count as often as they stand; ties of counts go to the smallest word in code-point order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written
from .textkernel import mix64

#: Letters of words, as a regular expression.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
PARTS = 3
#: Places of a matrix of words.
PLACES = 1 << 19
_U = np.uint64
FACTOR = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int = 31) -> DataFrame:
    """docs (doc_id, text) -> word, n: the words of all texts, A-Z in lower case.

    slip: of runs whose crc32 of `<doc_id>:<run>` it divides, the letter at crc32 % length is deleted, so that the
    counted words hold a known share of slips; 0 deletes none.
    """
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= least_length)
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        rows = rows.withColumn("run", F.when(F.col("h") % slip == 0, rest).otherwise(F.col("run"))).where(F.length("run") >= least_length)
    return rows.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, code points padded with 0): words of like length, PLACES places at a time."""
    words = column.to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for grade in np.unique(width := 1 << np.ceil(np.log2(np.maximum(sizes, 8))).astype(np.int64)).tolist():
        own = np.flatnonzero(width == grade)
        for k in range(0, len(own), max(1, PLACES // grade)):
            rows = own[k : k + max(1, PLACES // grade)]
            letters = np.frombuffer("".join(words[i] for i in rows.tolist()).encode("utf-32-le"), "<u4")
            grid = np.zeros((len(rows), int(sizes[rows].max())), np.uint64)
            grid[np.arange(grid.shape[1]) < sizes[rows, None]] = letters
            yield rows, sizes[rows], grid


def _pairs(grid: np.ndarray) -> np.ndarray:
    return grid[:, :-1] << _U(21) | grid[:, 1:]


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sizes, grid in _grids(batch.column(0)):
            found, n = np.unique(_pairs(grid)[np.arange(1, grid.shape[1]) < sizes[:, None]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["pair", "n"])


def _rarest(grid: np.ndarray, sizes: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where each word's three first bigrams of the global order begin; -1 for those that it lacks. order: pairs in ascending order, and their ranks."""
    width, last = grid.shape[1], np.iinfo(np.int64).max
    weight = np.full((len(grid), max(3, width - 1)), last, np.int64)
    there = np.arange(1, width) < sizes[:, None]
    weight[:, : width - 1][there] = order[1][np.searchsorted(order[0], _pairs(grid)[there])] * width + np.nonzero(there)[1]
    first = np.partition(weight, 2, axis=1)[:, :3]
    return np.where(first < last, first % width, -1)


def _keys(grid: np.ndarray, sizes: np.ndarray, places: np.ndarray, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the distinct join keys of words in pairs whose shorter word is `shorter` letters shorter than they are (0 or 1).

    A key hashes the shorter word's length, a prefix and a suffix; equal hashes only propose pairs.
    """
    rows, width = grid.shape
    front, back = np.zeros((width + 1, rows), _U), np.zeros((width + 1, rows), _U)  # hashes of the prefixes and suffixes of each length
    lines = np.arange(rows)
    for k in range(width):
        front[k + 1] = mix64(front[k] * _U(3) + grid[:, k] + _U(1))
        back[k + 1] = mix64(back[k] * _U(5) + grid[lines, np.maximum(sizes - 1 - k, 0)] + _U(2))
    line = np.repeat(lines, 3)
    place, size = places.ravel(), (sizes - shorter)[line]
    keys, owner = [], []

    def add(good: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
        i = line[good]
        keys.append(mix64(front[head[good], i] ^ mix64(back[tail[good], i] + size[good].astype(_U) * _U(0x9E3779B97F4A7C15) + head[good].astype(_U))))
        owner.append(i)

    behind = size - place - 2  # letters of the shorter word behind the bigram
    tail = sizes[line] - place  # from the bigram on
    before = size - tail
    for part in range(PARTS):
        good = (place >= 0) & (behind >= 0)
        add(good, place + 2 + behind * part // PARTS, behind - behind * (part + 1) // PARTS)
        good = (place >= 0) & (before >= 0)
        add(good, before * part // PARTS, before - before * (part + 1) // PARTS + tail)
    key, of = np.concatenate(keys), np.concatenate(owner)
    by = np.lexsort((key, of))
    key, of = key[by], of[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]


def _keyed(order, roles: tuple[int, ...]):
    """(word, n) -> key, word, n, longer: a row for each key of each role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sizes, grid in _grids(batch.column(0)):
                places = _rarest(grid, sizes, order.value)
                for role in roles:
                    keys, of = _keys(grid, sizes, places, role)
                    own = batch.take(pa.array(rows[of]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *own.columns, pa.array(np.full(len(keys), bool(role)))], ["key", "word", "n", "longer"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), distinct words of two letters or more -> word, n, near, near_n: every pair that differs by one inserted, deleted or replaced code point, in both directions."""
    spark = words.sparkSession
    # Letters are fewer than 100, so there are fewer than 10,000 bigrams; any other alphabet is bounded by its square.
    pairs = words.select("word").mapInArrow(_bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = (pairs.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    rank = np.empty(len(codes), np.int64)
    rank[np.lexsort((codes, counts))] = np.arange(len(codes))
    by = np.argsort(codes)
    order = spark.sparkContext.broadcast((codes[by].astype(_U), rank[by]))
    side = lambda *roles: words.select("word", "n").mapInArrow(_keyed(order, roles), "key long, word string, n long, longer boolean")
    a = side(0).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = side(0, 1).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("longer").alias("b_longer"))
    meet = a.join(b, "key").where("b_longer or a < b").where(F.levenshtein("a", "b", 1) == 1)
    found = meet.select("a", "a_n", "b", "b_n").distinct()
    row = lambda x, y: F.struct(F.col(x).alias("word"), F.col(x + "_n").alias("n"), F.col(y).alias("near"), F.col(y + "_n").alias("near_n"))
    return found.select(F.explode(F.array(row("a", "b"), row("b", "a"))).alias("r")).select("r.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), one row a word, without cycles -> word, root: the end of the chain of forms."""
    now = written(forms.select("word", F.col("form").alias("to")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("to").alias("far"))
        after = written(now.join(ahead, F.col("to") == F.col("at"), "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "roots")
        more = bool(after.where("moved").take(1))
        discard(now)
        now = after
        if not more:
            return now.select("word", F.col("to").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int = 31, factor: int = FACTOR) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n; one row for each word of the table of words."""
    words = written(word_counts(docs, least_length, least_count, slip), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    facts = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    facts = facts.select(F.col("word").alias("of"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    good = F.col("near_n") >= factor * F.col("n")
    rows = words.join(facts, F.col("word") == F.col("of"), "left")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    discard(words)
    out = rows.join(ends, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
