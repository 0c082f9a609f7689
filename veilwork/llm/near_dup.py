"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch. A set's sketch has `COORDS` coordinates. In round i each element is hashed to one coordinate
(rounds below COORDS) or to coordinate i - COORDS (the next COORDS rounds), with a value that orders
first by round, then by hash; a coordinate keeps the least value. Later rounds run only while some
coordinate is empty, so large sets take one or two rounds and every non-empty set fills all
coordinates. The share of equal coordinates estimates the Jaccard similarity without bias and
obeys Hoeffding's bound. (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, 2017.)

Candidates. Documents with equal words in equal order form a class (by BLAKE2b over their words' BLAKE2b digests)
and only its least document goes on; equal sets of other texts are linked like any others. Shingles are counted by
their words, not by hashes. Classes that agree on one of BANDS bands of ROWS coordinates
share a bucket. At similarity 0.8 a pair misses all 51 bands with probability (1 - 0.8^5)^51 = 1.6e-9.

Verification. All-pairs work inside a bucket is avoided in two steps. First each class is compared
with the least member of each of its buckets, and linked classes take the least label two hops away. Then
the members of the buckets that still hold several labels are compared across labels, by an exact prefix
filter: every set lists its shingles in one common order, rare ones first (any order is exact; the counts
that make it good are kept in a table of fixed size). Of two linked sets the smaller must share a shingle
of its short prefix (what may lie before the needed overlap with a set of its own size or more) with the
larger one's long prefix (the same for a set of any allowed size), at places that leave room for the
overlap. So copies that differ by more than the threshold, of a group however large, share no such place,
though they share most shingles; and no link is lost. Links are confirmed on full sets whose words were
compared byte by byte; 64-bit hashes only propose.

Defined cases: null, empty or blank texts have no shingles and link with nothing; texts of any length are
read whole. `near_duplicates`: rows with a null doc_id are kept, link with nothing and have a null component;
rows that share a doc_id are one vertex. `distinct_texts`: rows that share a doc_id but not the text, and
rows with a null doc_id, are documents of their own; of rows with equal id and text the least stays. Any
other columns are ignored or passed through; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import discard, ordered, written
from .textkernel import LOWER, NON_SPACE, PIECE_BYTES, mix64, pieces, run_ranks, span_ranks, sub_batches, text_buffers, word_bounds

COORDS, ROWS, BANDS = 255, 5, 51
#: Slots of the table of shingle counts.
SLOTS = 1 << 18
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def _rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    out = hashes
    for k in range(1, words):
        out = mix64(out[: len(out) - 1] * _U(3) + hashes[k:]) if len(out) else out
    return out


def _word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A row of 16 bytes (BLAKE2b) for each rank of words."""
    first = np.zeros(int(ranks.max()) + 1 if len(ranks) else 0, np.int64)
    first[ranks] = np.arange(len(ranks))
    raw = data.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.uint8).reshape(-1, 16)


def _hashes(digests: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its digest."""
    return np.ascontiguousarray(digests[:, :8]).view("<u8").ravel()


def _distinct(hashes: np.ndarray, ranks: np.ndarray, words: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of `words` ranks; runs are told apart by their words, so a hash may stand twice."""
    own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.zeros(len(hashes), bool)
    for k in range(words):
        odd |= ranks[k : k + len(hashes)] != ranks[where[back] + k]
    if odd.any():
        others = {tuple(ranks[i : i + words].tolist()): hashes[i] for i in np.flatnonzero(odd).tolist()}
        own = np.sort(np.concatenate([own, np.array([*others.values()], _U)]))
    return own


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; fewer words than `words` make one shingle."""
    return (x for x, _ in keyed_sets(column, words))


def keyed_sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """`shingle_sets`, each with a digest of the text's words in their order."""
    for first, end, data, off in pieces(column):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, off, NON_SPACE)
        ranks = span_ranks(data, starts, ends)
        digests = _word_digests(data, starts, ends, ranks)
        hashes = _hashes(digests)[ranks]
        rolled = _rolled(hashes, words)
        for i in range(end - first):
            a, b = at[i], at[i + 1]
            n = int(b - a)
            if n >= words:
                own = _distinct(rolled[a : b - words + 1], ranks[a:b], words)
            elif n:  # told apart from longer sequences by the number of words
                own = mix64(_rolled(hashes[a:b], n) + _U(n))
            else:
                own = hashes[:0]
            yield own, hashlib.blake2b(digests[ranks[a:b]].tobytes(), digest_size=16).digest()


def exact_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct numbers of the shingles of each text, equal within this column exactly where the shingles are equal."""
    data, off = text_buffers(column)
    data = LOWER[data]
    starts, ends, at = word_bounds(data, off, NON_SPACE)
    ranks, n = span_ranks(data, starts, ends), np.diff(at)
    rolled = run_ranks(ranks, words)
    out = [np.unique(rolled[at[i] : at[i + 1] - words + 1]) if n[i] >= words else ranks[:0] for i in range(len(n))]
    short: dict[tuple, int] = {}
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        out[i] = np.array([-1 - short.setdefault(tuple(ranks[at[i] : at[i + 1]].tolist()), len(short))], np.int64)
    return out


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of `coords` 16-bit coordinates for each non-empty set."""
    sizes = np.array([len(x) for x in sets], np.int64)
    n = len(sets)
    table = np.full(n * coords, _EMPTY, _U)
    if not n:
        return np.zeros((0, coords), np.uint16)
    value, owner, open_ = np.concatenate(sets), np.repeat(np.arange(n), sizes), sizes > 0
    for i in range(2 * coords):
        x = mix64(value ^ _U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        at = owner * coords + (((x >> _U(32)) * _U(coords) >> _U(32)).astype(np.int64) if i < coords else i - coords)
        np.minimum.at(table, at, (_U(i) << _U(48)) | (x & _U((1 << 48) - 1)))
        which = np.flatnonzero(open_)
        open_[which] = (table.reshape(n, coords)[which] == _EMPTY).any(axis=1)
        more = open_[owner]
        if not more.any():
            break
        value, owner = value[more], owner[more]
    return mix64(table.reshape(n, coords)).astype(np.uint16)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|, on sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


SUMMARY = "doc_id long, digest string, n_shingles long, set_key binary, sketch binary"


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            sets, keys = zip(*keyed_sets(batch.column(2), words), strict=True)
            full = [x for x in sets if len(x)]
            lines = (line for k in range(0, len(full), 500) for line in sketches(full[k : k + 500]))
            drawn = [next(lines).tobytes() if len(x) else None for x in sets]
            keys = [k if len(x) else None for k, x in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(drawn, pa.binary())], ["doc_id", "digest", "n_shingles", "set_key", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 2000):
            batch = whole.slice(at, 2000)
            coords = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, COORDS).astype(_U)
            keys = np.empty((len(coords), BANDS), _U)
            for band in range(BANDS):
                key = np.full(len(coords), band + 1, _U)
                for k in range(ROWS):
                    key = mix64(key * _U(65537) + coords[:, band * ROWS + k])
                keys[:, band] = key
            spread = [np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(spread[0]), pa.array(spread[1])], ["bucket", "rep", "size"])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(SLOTS - 1)).astype(np.int64)


def _slot_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in sub_batches(batches, "text"):
            for x in shingle_sets(batch.column(0), words):
                np.add.at(counts, _slot(x), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["slot", "n"])

    return run


def _prefixes(words: int, percent: int, counts):
    """(rep, size, label, text) -> a row for each shingle of the set's long prefix, with its place in the common order; `short` marks the short prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            tokens, spread, places, short = [], [], [], []
            for k, x in enumerate(shingle_sets(batch.column(3), words)):
                n = len(x) - (percent * len(x) + 99) // 100 + 1 if len(x) else 0
                order = np.lexsort((x, counts.value[_slot(x)]))[:n]
                tokens.append(x[order])
                spread.append(np.full(len(order), k))
                places.append(np.arange(len(order)))
                short.append((100 + percent) * (len(x) - places[-1]) >= 2 * percent * len(x))
            pick = np.concatenate(spread)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(batch.column(c).to_numpy()[pick]) for c in range(3)), pa.array(np.concatenate(places).astype(np.int64)), pa.array(np.concatenate(short))], ["bucket", "rep", "size", "label", "place", "short"])

    return run


def _split(rows: DataFrame, table_: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that a grouping made one row a key. A hash of the key is a second key: so Spark shuffles
    both sides for this join, instead of reusing the grouping's exchange, and can split the partition of a hot key."""
    return rows.join(table_, (F.col(left) == F.col(right)) & (F.xxhash64(left) == F.xxhash64(right)), how)


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (bucket, label, ...) of buckets that hold several labels, with each bucket's commonest label as main."""
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top")).where("parts > 1")
    mixed = mixed.select(F.col("bucket").alias("k"), F.col("top.label").alias("main"))
    return _split(rows, mixed, "bucket", "k").drop("k")


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(sub_batches(batches, "text_b", PIECE_BYTES // 2), "text_a", PIECE_BYTES):
            own = batch.column(2).dictionary_encode()  # a star's centre stands in many rows
            sets = exact_sets(pa.concat_arrays([own.dictionary, batch.column(3)]), words)
            good = [linked(sets[k], y, percent) for k, y in zip(own.indices.to_pylist(), sets[len(own.dictionary) :], strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Each text meets its pairs by equi-joins whose hot keys Spark can split."""
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """links (a, b) with a < b -> (v, label): for each b the least vertex that one, then one more hop reaches."""
    one = links.groupBy("b").agg(F.min("a").alias("to"))
    two = one.select(F.col("b").alias("at"), F.col("to").alias("far"))
    return one.join(two, F.col("to") == F.col("at"), "left").select(F.col("b").alias("v"), F.coalesce("far", "to").alias("label"))


def _identified(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, digest (of the text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text")


def _digest() -> Column:
    return F.coalesce(F.sha1("text"), F.lit("null"))


def _groups(rows: DataFrame, usable: str, words: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(facts of every row, classes (set_key, doc_id, digest, rep, label)); rep numbers a class, label is its component's least rep.

    A class is numbered by its least doc_id; of classes with one least doc_id, all but one get a stand-in above 2^62, and so
    does a class of rows without id. by_id: classes that hold rows of one id are linked.
    """
    spark = rows.sparkSession
    facts = written(rows.mapInArrow(_summaries(words), SUMMARY), "facts")
    used = facts.where("set_key is not null").where(usable)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "sketch", "n_shingles"))
    classes = used.groupBy("set_key").agg(least.alias("r")).select("set_key", "r.doc_id", "r.digest", F.col("r.n_shingles").alias("size"), "r.sketch")
    classes = written(classes, "classes")
    several = classes.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("of"), "first")
    stand_in = F.lit(1 << 62) + F.conv(F.substring(F.sha1(F.concat_ws(" ", "doc_id", "digest")), 1, 15), 16, 10).cast("long")
    own = F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.col("set_key")))
    reps = classes.join(several, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    reps = written(reps.select("set_key", "doc_id", "digest", "size", "sketch", F.when(own, F.col("doc_id")).otherwise(stand_in).alias("rep")), "reps")

    members = reps.select("rep", "size", "sketch").mapInArrow(_bands, "bucket long, rep long, size long")
    buckets = members.groupBy("bucket").agg(F.min(F.struct("rep", "size")).alias("c"), F.max("rep").alias("top")).where("c.rep <> top")
    joint = _split(members, buckets.select(F.col("bucket").alias("k"), F.col("c.rep").alias("a"), F.col("c.size").alias("size_a")), "bucket", "k")
    joint = written(joint.select("bucket", "rep", "size", "a", "size_a"), "buckets")
    near = "100 * least(size, size_a) >= {0} * greatest(size, size_a)".format(percent)
    in_play = joint.where("rep <> a").select(F.explode(F.array("rep", "a")).alias("rep")).distinct().join(reps.select("rep", F.col("doc_id").alias("id"), F.col("digest").alias("of")), "rep")
    texts = rows.join(in_play, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    texts = written(texts.groupBy("rep").agg(F.min("text").alias("text")), "texts")  # repeated rows

    stars = written(joint.where("rep <> a").where(near).select("a", F.col("rep").alias("b")).distinct(), "stars")
    first = written(_verified(stars, texts, words, percent), "links")
    labels = written(_labels(first), "labels")

    named = joint.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("bucket", "rep", "size", F.coalesce("label", "rep").alias("label"))
    open_ = written(_mixed(named).select("rep", "size", "label").distinct().join(texts, "rep").select("rep", "size", "label", "text"), "open")
    counts = np.zeros(SLOTS, np.int64)
    drawn = open_.select("text").mapInArrow(_slot_counts(words), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[drawn.column("slot").to_numpy()] = drawn.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(counts)
    left = written(_mixed(open_.mapInArrow(_prefixes(words, percent, counts), "bucket long, rep long, size long, label long, place long, short boolean")), "mixed")
    small = left.where("short").select("bucket", F.col("rep").alias("x"), F.col("label").alias("label_x"), F.col("size").alias("size_x"), F.col("place").alias("place_x"), (F.col("label") == F.col("main")).alias("main_x"))
    room = f"size_x <= size and {100 + percent} * least(size - place, size_x - place_x) >= {percent} * (size + size_x) and label <> label_x"
    meet = lambda l, s: l.join(s, "bucket").where(room).select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b"))
    cross = meet(left, small.where("not main_x")).union(meet(left.where("label <> main"), small.where("main_x"))).distinct()  # no pairs within the main label
    likely = written(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    links = first.union(_verified(likely, texts, words, percent))
    if by_id:
        ids = used.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("d"))
        same = _split(used, ids, "doc_id", "d").select("d", "set_key").distinct().join(reps.select("set_key", "rep"), "set_key").select("d", "rep")
        links = links.union(_split(same, same.groupBy(F.col("d").alias("of")).agg(F.min("rep").alias("a")), "d", "of").where("a <> rep").select("a", F.col("rep").alias("b")))
    final = components(links).select(F.col("v").alias("rep"), "label")
    named = written(reps.drop("sketch").join(final, "rep", "left").select("set_key", "doc_id", "digest", "rep", F.coalesce("label", "rep").alias("label")), "named")
    discard(classes, reps, joint, texts, stars, first, labels, open_, left, likely)
    return facts, named


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Links documents whose sets of `words`-word shingles have a Jaccard similarity of percent / 100 or
    more; component_id is the least doc_id reachable and `kept` marks that document.
    """
    facts, named = _groups(_identified(docs), "doc_id is not null", words, percent, by_id=True)
    thin = facts.select("doc_id", "n_shingles", F.col("set_key").alias("key"))
    out = _split(thin, named.select("set_key", "label"), "key", "set_key", "left")
    out = written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    discard(facts, named)
    return out


def distinct_texts(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (any columns beside doc_id and text) without near-duplicates: one document of each group, that of the least doc_id.

    The rows themselves are shuffled once, by id and digest, where repeated rows are combined first: the least by their
    other columns stays (a map, which has no order, counts as its JSON).
    """
    facts, named = _groups(_identified(docs), "true", words, percent, by_id=False)
    stay = named.where("rep = label").select("doc_id", "digest").union(facts.where("set_key is null").select("doc_id", "digest").distinct())
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"))
    order = F.struct(*(F.col(f.name) if ordered(f.dataType) else F.to_json(F.struct(f.name)).alias(f.name) for f in docs.schema if f.name != "text"))
    rows = docs.groupBy(F.col("doc_id").cast("long").alias("__doc"), _digest().alias("__digest")).agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    return rows.join(stay, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left_semi").select("__row.*")
